"""Decisions about a question and its evidence: is an opinion asked for, how far can the sources be trusted, was the answer a refusal.

Sources are an array of structs, best first, with at least ``company``, ``relevance_score`` and ``company_name_mismatch``
(three-valued: null is unchecked).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.4
#: Wording that asks for a verdict, Spanish then English.
SUBJECTIVE = (
    "mejor", "recomendarías", "recomiendas", "debería", "opinión", "preferirías", "conviene", "vale la pena", "qué tan riesgoso", "invertir en", "comprar acciones",
    "should i", "would you recommend", "do you recommend", "is it worth", "good investment", "good buy", "good long-term", "good long term", "worth buying", "worth investing",
    "what would you recommend", "advise", "your opinion", "how risky",
)
#: The mark of an answer that isn't in the context, and wording of refusals.
SENTINEL = "NOT_IN_CONTEXT"
REFUSALS = (
    "not contain", "does not include", "no se incluye", "no contiene", "not possible to determine", "cannot be determined", "no encontr", "insufficient information", "no information about",
)
NOT_IN_FILINGS = "The retrieved filing excerpts do not contain this information. "
#: Our own wording of what is added to answers and prompts.
LOW_NOTICE = "Note: the best excerpt for this question was a weak match, so its evidence may be only loosely related."
UNVERIFIED_NOTICE = "Note: the company named by at least one source of this answer is still being verified; treat it as provisional."
NOTES = {
    "unverified_source": "An excerpt's company is still being verified; don't present it as confirmed.",
    "low_confidence": "The excerpts match weakly; answer only what they support and say so first."
}
NOT_FOUND_ANSWER = "No filing of that company or period is available."
NO_VERDICT_ANSWER = "No recommendation or opinion can be given; the figures of the filings can be shown instead."
WEAK_ANSWER = "The excerpts that were found are too weak for a precise answer."
NO_PROVIDER_ANSWER = "[no language model configured]"


def is_subjective(question: Column) -> Column:
    """A marker anywhere in the question."""
    low = F.lower(question)
    found = F.lit(False)
    for m in SUBJECTIVE:
        found = found | low.contains(m)
    return F.coalesce(found, F.lit(False))


def _best(sources: Column) -> Column:
    """The source of highest score, the first of equals; a null score counts as 0."""
    scored = F.transform(
        sources,
        lambda s, i: F.struct(
            F.coalesce(s["relevance_score"], F.lit(0.0)).alias("score"), (-i).alias("first"), s["company"].alias("company")
        )
    )
    return F.array_max(scored)


def confidence_flag(question: Column, sources: Column) -> Column:
    """E04, in strict order."""
    top = _best(sources)
    unverified = F.exists(sources, lambda s: s["company"].eqNullSafe(top["company"]) & s["company_name_mismatch"].isNull())
    return (
        F.when(is_subjective(question), "subjective_no_verdict")
        .when(sources.isNull() | (F.size(sources) <= 0), "entity_not_found")
        .when(top["score"] < LOW_CONFIDENCE, "low_confidence")
        .when(unverified, "unverified_source")
        .otherwise("ok")
    )


def is_refusal(answer: Column) -> Column:
    """The sentinel anywhere, or refusing words near the start."""
    bare = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    head = F.lower(F.substring(bare, 1, 400))
    found = bare.contains(SENTINEL)
    for p in REFUSALS:
        found = found | head.contains(p)
    return F.coalesce(found, F.lit(False))


def without_sentinel(answer: Column) -> Column:
    """E06."""
    rest = F.regexp_replace(F.regexp_replace(answer, rf"(?s)^(.*?){SENTINEL}(.*)$", "$1$2"), r"^[ \n:.-]+", "")
    clean = F.regexp_replace(F.concat(F.lit(NOT_IN_FILINGS), rest), r"(?U)^\s+|\s+$", "")
    return F.when(answer.contains(SENTINEL), clean).otherwise(answer)


def context(sources: Column) -> Column:
    """E07's numbered excerpts; the snippet stands in for missing content, ``?`` for missing fields."""

    def part(s: Column, i: Column) -> Column:
        def field(name: str) -> Column:
            return F.coalesce(s[name].cast("string"), F.lit("?"))

        head = F.concat(
            F.lit("["),
            (i + 1).cast("string"),
            F.lit("] "),
            field("company"),
            F.lit(" ("),
            field("ticker"),
            F.lit(") FY"),
            field("fiscal_year"),
            F.lit(" - "),
            field("canonical_section")
        )
        body = F.coalesce(F.nullif(s["content"], F.lit("")), s["text_snippet"], F.lit(""))
        return F.concat(head, F.lit("\n"), body)

    return F.array_join(F.transform(sources, part), "\n\n")


def prompt(question: Column, sources: Column, flag: Column) -> Column:
    """Context, question, and the note of the flag."""
    note = F.lit("")
    for name, text in NOTES.items():
        note = F.when(flag == name, F.lit(f"\n\nNOTE\n{text}")).otherwise(note)
    return F.concat(F.lit("CONTEXT\n"), context(sources), F.lit("\n\nQUESTION\n"), question, note)


def with_notice(answer: Column, notice: str) -> Column:
    """Added once."""
    return F.when(answer.contains(notice), answer).otherwise(F.concat(answer, F.lit("\n\n" + notice)))


def answered(flag: Column, generated: Column) -> Column:
    """E09 after the model: (answer, flag), with canned answers, refusals and notices. ``generated`` may be null: no provider."""
    text = F.when(flag == "entity_not_found", NOT_FOUND_ANSWER).when(flag == "subjective_no_verdict", NO_VERDICT_ANSWER).otherwise(
        F.coalesce(generated, F.when(flag == "low_confidence", WEAK_ANSWER).otherwise(NO_PROVIDER_ANSWER))
    )
    live = ~flag.isin("entity_not_found", "subjective_no_verdict")
    noted = F.when(
        flag == "unverified_source", with_notice(text, UNVERIFIED_NOTICE)
    ).when(flag == "low_confidence", with_notice(text, LOW_NOTICE)).otherwise(text)
    refused = live & is_refusal(text)
    return F.struct(
        F.when(refused, without_sentinel(text)).otherwise(noted).alias("answer"),
        F.when(refused, "no_answer_in_context").otherwise(flag).alias("flag")
    )
