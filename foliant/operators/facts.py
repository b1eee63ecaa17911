"""Mining facts from statement lines, and the question sets made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

SEED, MAX_A_SHARE = 20260902, 0.40
#: What a column of figures, an empty column and a line look like.
_NUM = r"\$?\s*\(?\s*\d[\d,]*(?:\.\d+)?\s*\)?"
_DASH = r"(?:[—–-]+|n/?a)"
_COL = rf"(?:{_NUM}|{_DASH})"
LINE = rf"^([A-Za-z][A-Za-z'’()&/,.\s-]{{2,60}}?)\s*[:.]?\s*({_COL}(?:\s+{_COL}){{0,7}})\s*$"
#: What a stripped line that ``LINE`` takes can end in, and what parts lines: the empty lines that CR LF makes are too short to be any.
ENDS, BREAKS = "0123456789,)—–-a", r"[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
NOT_AMOUNTS = r"(?i)per share|per diluted|%|percent"
#: Well-known companies to look for among those that the corpus lacks, and names that exist nowhere.
KNOWN = {"MSFT": "Microsoft", "TSLA": "Tesla", "GOOGL": "Alphabet", "NVDA": "NVIDIA", "JPM": "JPMorgan Chase"}


def fact_lines(chunks: DataFrame, content: str = "content") -> DataFrame:
    """F32, P20: a row a statement line with ``label``, ``value`` of the first column, ``n_figures`` and ``source_line``."""
    kept = [c for c in chunks.columns if c != content]
    # Stripped once; most lines of prose end in none of ``ENDS`` and never become rows.
    stripped = F.transform(F.split(content, BREAKS), T.strip)
    likely = F.filter(stripped, lambda x: F.length(x).between(10, 320) & F.substring(x, -1, 1).isin(*ENDS))
    lines = chunks.select(*kept, F.explode(likely).alias("source_line"))
    sized = lines.where(F.col("source_line").rlike(LINE) & ~F.col("source_line").rlike(NOT_AMOUNTS))
    parsed = sized.withColumn(
        "label", T.label_name(F.regexp_extract("source_line", LINE, 1))
    ).where("label IS NOT NULL").withColumn(
        "c", F.regexp_extract_all(F.regexp_extract("source_line", LINE, 2), F.lit(_COL), F.lit(0))
    )
    first = F.trim(F.get("c", F.lit(0)))
    good = F.size("c").between(1, 6) & ~first.rlike(rf"^{_DASH}$") & (F.length(F.regexp_replace(first, r"[^\d]", "")) >= 3)
    return parsed.where(good).select(
        *kept, "label", F.regexp_replace(first, r"\s+", "").alias("value"), F.size("c").alias("n_figures"), "source_line"
    )


def year_specific(facts: DataFrame) -> DataFrame:
    """Without values that stand in two years of one company and label."""
    keys = ["company", "label", "value"]
    twice = facts.groupBy(*keys).agg(F.count_distinct("fiscal_year").alias("years")).where("years > 1")
    return facts.join(twice.select(*keys), keys, "left_anti")


def confusable(companies: DataFrame, company: str = "company") -> DataFrame:
    """Per first name part of four letters or more the first two companies that share it."""
    head = F.lower(F.get(F.split(company, "[-_ ]"), 0))
    grouped = companies.select(company, head.alias("head")).where(F.length("head") >= 4).groupBy("head").agg(
        F.slice(F.array_sort(F.collect_set(company)), 1, 2).alias("two")
    )
    return grouped.where(F.size("two") == 2).select("head", F.get("two", F.lit(0)).alias("first"), F.get("two", F.lit(1)).alias("second"))


def year_pairs(facts: DataFrame) -> DataFrame:
    """Per company its earliest and latest fact, where label agrees and years and values don't. Ties go by label, then value."""
    fact = F.struct("fiscal_year", "label", "value")
    pairs = facts.groupBy("company").agg(F.min(fact).alias("lo"), F.max(F.struct("fiscal_year", "label", "value")).alias("hi"))
    return pairs.where("lo.label = hi.label AND lo.fiscal_year <> hi.fiscal_year AND lo.value <> hi.value").select(
        "company",
        F.col("lo.label").alias("label"),
        F.col("lo.fiscal_year").alias("first_year"),
        F.col("lo.value").alias("first_value"),
        F.col("hi.fiscal_year").alias("last_year"),
        F.col("hi.value").alias("last_value")
    )


def stratified(facts: DataFrame, n: int, key: Column, seed: int = SEED, share: float = MAX_A_SHARE) -> DataFrame:
    """``n`` facts, one a company, in turns over first letters; ``A`` gets at most ``share``. The order within a letter is that of the MD5 of ``key``
    and the seed: alike in distribution to a shuffle, and the same on each run; facts of a company that agree in it go by label, value, year and ticker."""
    letter = F.upper(F.substring(F.coalesce(F.nullif("ticker", F.lit("")), F.col("company")), 1, 1))
    rows = facts.withColumn("letter", letter).withColumn("__h", F.md5(F.concat(key, F.lit(f"|{seed}"))))
    one = rows.withColumn("__c", F.row_number().over(Window.partitionBy("company").orderBy("__h", "label", "value", "fiscal_year", "ticker"))).where("__c = 1")
    turn = one.withColumn("turn", F.row_number().over(Window.partitionBy("letter").orderBy("__h", "company")))
    capped = turn.where((F.col("letter") != "A") | (F.col("turn") <= int(n * share)))
    return capped.orderBy("turn", "letter").limit(n).drop("__h", "__c")


def absent(spark: SparkSession, corpus: DataFrame, ticker: str = "ticker", limit: int = 4) -> DataFrame:
    """Known tickers that the corpus lacks."""
    known = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(KNOWN.items())], "place int, ticker string, name string")
    return known.join(
        corpus.select(F.upper(ticker).alias("ticker")).distinct(), "ticker", "left_anti"
    ).orderBy("place").limit(limit).select("ticker", "name")


def questions(facts: DataFrame, category: str, template: str, source: str = "mined", truth: Column | None = None) -> DataFrame:
    """a question a fact. ``template`` may name {company}, {typo}, {ticker}, {label} and {year}."""
    name = T.display_name(F.col("company"))
    parts = {
        "{company}": name,
        "{typo}": T.misspelt(name),
        "{ticker}": F.col("ticker"),
        "{label}": F.col("label"),
        "{year}": F.col("fiscal_year").cast("string")
    }
    q = F.lit(template)
    for k, v in parts.items():
        if k in template:
            q = F.replace(q, F.lit(k), v)
    fact = F.concat(
        F.upper(F.substring("label", 1, 1)),
        F.lower(F.substring("label", 2, 1000)),
        F.lit(": "),
        "value",
        F.lit(" ("),
        name,
        F.lit(", FY"),
        F.col("fiscal_year").cast("string"),
        F.lit(")")
    )
    return facts.select(
        F.lit(category).alias("category"),
        q.alias("question"),
        "company",
        "ticker",
        "fiscal_year",
        (fact if truth is None else truth).alias("ground_truth_answer"),
        F.lit(source).alias("source")
    )


def question_set(parts: list[DataFrame], quotas: list[int]) -> DataFrame:
    """parts in order, each up to its quota, numbered from 1."""
    out = None
    for i, (part, n) in enumerate(zip(parts, quotas, strict=True)):
        rows = part.orderBy("company", "question").limit(n).withColumn("__part", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    # As many rows as the quotas allow.
    return out.withColumn("id", F.row_number().over(Window.orderBy("__part", "company", "question"))).drop("__part")


#: The categories of the evaluation set with their quotas, in order.
QUOTAS = {
    "exact_fact": 13, "fuzzy_no_ticker": 13, "fiscal_year_discrimination": 8, "disambiguation": 6, "typo_tolerance": 4, "multi_year_comparison": 4, "language_parity": 2,
    "not_found_structural": 4, "not_found_fictional": 3, "off_topic": 4, "subjective_gate": 5, "edge_case_garbled": 2,
}
#: What mined questions ask.
ASKED = "What was {company}'s {label} in fiscal {year}?"
ASKED_BY_TICKER = "What was {ticker}'s {label} in fiscal {year}?"
ASKED_WITH_TYPO = "What was {typo}'s {label} in fiscal {year}?"
ASKED_OVER_YEARS = "How did {company}'s {label} change across the years shown in its FY{year} filing?"
ASKED_IN_SPANISH = "¿Cuál fue el {label} de {company} en el año fiscal {year}?"
#: Our own questions that aren't mined: names that exist nowhere, other topics, verdicts, and garbled wording.
FICTIONAL = ("Quillmark Foundries", "Ostrava Lumen Works", "Peltry & Vane Group")
OFF_TOPIC = (
    "How long should rye bread rest before it is baked?",
    "Why do tides come twice a day?",
    "Show me how to sort a list of dates in Java.",
    "Which country hosted the winter games of 1994?"
)
VERDICTS = (
    "Is now the moment to buy Apple shares?", "Would you keep Apple in a pension fund for twenty years?", "How much Apple stock ought I to own?",
    "¿Qué empresa me conviene más para mis ahorros?", "¿Debería vender mis acciones de Apple este mes?",
)
GARBLED = ("appel totl revnue in fy 2022 how mch", "AAPL sales 2022 / 2021 ?? totl")
#: Our own wording of what is expected of them.
EXPECTED = {
    "not_found_structural": "A real company that the corpus lacks: the answer says so and uses no other company's filing.", "not_found_fictional": "No such company: nothing is resolved.",
    "off_topic": "Out of scope: refused, without figures.", "subjective_gate": "Advice is asked for: no verdict is given.", "edge_case_garbled": "Garbled, but it names Apple and a year.",
}


def evaluation_set(facts: DataFrame, corpus: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """(id, category, question, company, ticker, fiscal_year, ground_truth_answer, source) of all twelve categories, each up to its quota.

    ``facts`` are those of ``fact_lines`` with ``n_figures`` and ``source_line``; ``corpus(company, ticker)`` is what there is. Lines of up to three figures
    are single facts, of two to four comparisons. Names, typos and Spanish take companies that no category before them took.
    """
    spark = facts.sparkSession
    key = F.concat(F.col("company"), F.col("label"), F.col("fiscal_year").cast("string"))
    single, multi = year_specific(facts.where("n_figures <= 3")), facts.where("n_figures BETWEEN 2 AND 4")
    parts: dict[str, DataFrame] = {}

    def free(rows: DataFrame) -> DataFrame:
        """Facts of companies that no question asks about yet."""
        for part in parts.values():  # each has as many rows as its quota at most
            rows = rows.join(F.broadcast(part.select("company").distinct()), "company", "left_anti")
        return rows

    def mined(category: str, pool: DataFrame, template: str, source: str, **more) -> None:
        parts[category] = questions(stratified(pool, quotas[category], key), category, template, source, **more)

    mined("exact_fact", single.where(F.coalesce("ticker", F.lit("")) != ""), ASKED_BY_TICKER, "mined:ticker")
    mined("fuzzy_no_ticker", free(single), ASKED, "mined:name")

    years = year_pairs(single).orderBy(
        F.md5(F.concat("company", F.lit(f"|{SEED}"))), "company"
    ).limit(-(-quotas["fiscal_year_discrimination"] // 2))
    both = F.explode(
        F.array(
            F.struct(F.col("first_year").alias("fiscal_year"), F.col("first_value").alias("value")),
            F.struct(F.col("last_year").alias("fiscal_year"), F.col("last_value").alias("value"))
        )
    )
    ticker = single.groupBy("company").agg(F.min("ticker").alias("ticker"))
    pairs = years.select("company", "label", both.alias("y")).select("company", "label", "y.fiscal_year", "y.value").join(ticker, "company")
    parts["fiscal_year_discrimination"] = questions(
        pairs, "fiscal_year_discrimination", ASKED, "mined:year-pair"
    ).limit(quotas["fiscal_year_discrimination"])

    alike = confusable(corpus).select(F.explode(F.array("first", "second")).alias("company"))
    last = single.join(alike, "company", "left_semi").withColumn(
        "__r", F.row_number().over(Window.partitionBy("company").orderBy(F.col("fiscal_year").desc(), "label", "value"))
    ).where("__r = 1").drop("__r")
    parts["disambiguation"] = questions(
        last.orderBy("company").limit(quotas["disambiguation"]), "disambiguation", ASKED, "mined:confusable"
    )
    mined("typo_tolerance", free(single), ASKED_WITH_TYPO, "mined:typo")
    mined(
        "multi_year_comparison",
        multi,
        ASKED_OVER_YEARS,
        "mined:multiyear",
        truth=F.concat(F.lit("Most recent year first: "), "source_line")
    )
    mined("language_parity", free(single), ASKED_IN_SPANISH, "mined:es")

    def written(category: str, rows: list[tuple[str, str | None, str | None, int | None]]) -> None:
        made = [(category, q, c, t, y, EXPECTED[category], "handwritten") for q, c, t, y in rows[: quotas[category]]]
        parts[category] = spark.createDataFrame(made, "category string, question string, company string, ticker string, fiscal_year int, ground_truth_answer string, source string")

    lacking = [(f"What was {r['name']}'s total revenue in fiscal 2022?", None, r["ticker"], 2022) for r in absent(spark, corpus, limit=quotas["not_found_structural"]).collect()]  # a few of KNOWN
    written("not_found_structural", lacking)
    written("not_found_fictional", [(f"What is {n}'s main product line?", None, None, None) for n in FICTIONAL])
    written("off_topic", [(q, None, None, None) for q in OFF_TOPIC])
    written("subjective_gate", [(q, None, None, None) for q in VERDICTS])
    written("edge_case_garbled", [(q, "apple-inc", "AAPL", 2022) for q in GARBLED])
    return question_set([p.withColumn("fiscal_year", F.col("fiscal_year").cast("int")) for p in parts.values()], [quotas[c] for c in parts])
