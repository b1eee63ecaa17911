"""SQL for the target encoding, by windows over all earlier moments less those of the row's own fold."""

_LEVELS = ("item", "kind", "vendor", "nation", "client", "segment", "every")


def _history(level: str) -> str:
    """Lines and hits of the row's value and earlier moments, all folds less its own."""
    frame = "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP"
    over = [f"(PARTITION BY {keys} ORDER BY sold_at {frame})" for keys in (f"{level}_v", f"{level}_v, fold")]
    return ", ".join(f"coalesce(sum({c}) OVER {over[0]}, 0) - coalesce(sum({c}) OVER {over[1]}, 0) AS {level}_{x}" for c, x in (("lines", "n"), ("hits", "s")))


def _rate(level: str, prior: str) -> str:
    return f"CASE WHEN {level}_n < 1 THEN {prior} ELSE (1000000 * {level}_s + 50 * {prior})::BIGINT // ({level}_n + 50)::BIGINT END"


#: crc32 of a sale_id's decimal digits, bit by bit: the register starts at all ones, takes a character, and is divided by the reversed polynomial.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda r, c: list_reduce(list_prepend(xor(r, c), list_value(0, 0, 0, 0, 0, 0, 0, 0)::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))"""

OP11_SQL = f"""
WITH s AS MATERIALIZED (
  SELECT sale_id, coalesce(client_id, -1) AS client_v, sold_at, xor({_CRC}, 4294967295::BIGINT) % 5 AS fold FROM sales WHERE sold_at IS NOT NULL),
l AS MATERIALIZED (
  SELECT sale_id, coalesce(item_id, -1) AS item_v, vendor_id AS vendor_v, count(*) AS lines, count(*) FILTER (flag = 'returned') AS hits
  FROM sale_lines GROUP BY 1, 2, 3),
j AS MATERIALIZED (
  SELECT l.*, client_v, sold_at, fold, kind AS kind_v, vendors.nation_id AS nation_v, segment AS segment_v, 0 AS every_v
  FROM l JOIN s USING (sale_id) LEFT JOIN items ON item_id = item_v LEFT JOIN vendors ON vendor_id = vendor_v LEFT JOIN clients ON client_id = client_v),
h AS MATERIALIZED (SELECT *, {", ".join(map(_history, _LEVELS))} FROM j),
t AS (SELECT *, {_rate("every", "500000")} AS top FROM h),
p AS (SELECT *, {_rate("kind", "top")} AS kind_r, {_rate("nation", "top")} AS nation_r, {_rate("segment", "top")} AS segment_r FROM t)
SELECT sale_id, item_v AS item_id, vendor_v AS vendor_id, lines AS n_lines, hits AS n_returned,
  CAST(item_n AS BIGINT) AS item_n, CAST({_rate("item", "kind_r")} AS BIGINT) AS item_rate,
  CAST(vendor_n AS BIGINT) AS vendor_n, CAST({_rate("vendor", "nation_r")} AS BIGINT) AS vendor_rate,
  CAST(client_n AS BIGINT) AS client_n, CAST({_rate("client", "segment_r")} AS BIGINT) AS client_rate
FROM p
"""

#: Code points are what substr and length count; the marks part the pieces again.
OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM d),
f AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""
