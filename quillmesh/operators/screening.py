"""Decisions: parsing, evidence policy, queue scores and bands, relevance, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, count_criteria, strip, strip_fences

DECISIONS = ("include", "exclude", "maybe")
#: What an unparseable response becomes.
ON_ERROR = {"maybe": "maybe", "pending": "pending", "blank": ""}


def parse_decisions(responses: DataFrame, on_error: str = "maybe") -> DataFrame:
    """Adds parsed, decision, rationale, matched_ic, matched_ec; ``on_error`` also has the mode "guess"."""
    schema = "struct<decision:string,rationale:string,matched_ic:array<string>,matched_ec:array<string>>"
    data = F.from_json(strip_fences(F.col("response")), schema, {"mode": "PERMISSIVE"})
    out = responses.withColumn("_data", data).withColumn("parsed", F.coalesce(F.col("_data.decision").isNotNull() | F.col("_data.rationale").isNotNull(), F.lit(False)))
    low = F.lower("response")
    guess = reduce(lambda rest, d: F.when(F.contains(low, F.lit(d)), d).otherwise(rest), reversed(DECISIONS), F.lit("maybe"))
    failed = guess if on_error == "guess" else F.lit(ON_ERROR[on_error])
    said = F.lower("_data.decision")
    return out.withColumns(
        {
            "decision": F.when(~F.col("parsed"), failed).when(said.isin(*DECISIONS), said).otherwise("maybe"),
            "rationale": F.left(F.coalesce("_data.rationale", F.lit("")), F.lit(500)),
            "matched_ic": F.array_join(F.coalesce("_data.matched_ic", F.array().cast("array<string>")), "|"),
            "matched_ec": F.array_join(F.coalesce("_data.matched_ec", F.array().cast("array<string>")), "|"),
        }
    ).drop("_data")


def parse_pages(responses: DataFrame, ok: str = "succeeded", on_error: str = "maybe") -> DataFrame:
    """Responses with a status: those that failed have no decision; adds state (failed, unparsed or parsed)."""
    out = parse_decisions(responses, on_error)
    failed = F.coalesce(F.col("status"), F.lit("")) != ok
    state = F.when(failed, "failed").when(F.col("parsed"), "parsed").otherwise("unparsed")
    return out.withColumns({"state": state, "decision": F.when(~failed, F.col("decision"))})


def evidence_policy(df: DataFrame, lowered: str = "maybe", note: str = "Abstract missing: include lowered, needs review.") -> DataFrame:
    """Without an abstract: two tags more, low confidence, manual review, and no include."""
    missing = blank_to_null(F.col("abstract")).isNull()
    tags = F.filter(F.split(F.coalesce("evidence_tags", F.lit("")), r"\|"), lambda x: x != "")
    more = F.array_join(F.array_sort(F.array_union(tags, F.array(F.lit("insufficient_abstract"), F.lit("full_text_required")))), "|")
    demoted = missing & (F.col("decision") == "include")
    return df.withColumns(
        {
            "evidence_status": F.when(missing, "missing_abstract").otherwise("verified_abstract"),
            "evidence_tags": F.when(missing, more).otherwise(F.col("evidence_tags")),
            "confidence": F.when(missing, "low").otherwise(F.col("confidence")),
            "manual_review_required": missing,
            "rationale": F.when(demoted, strip(F.concat(strip(F.coalesce("rationale", F.lit(""))), F.lit(" " + note)))).otherwise(F.col("rationale")),
            "decision": F.when(demoted, lowered).otherwise(F.col("decision")),
        }
    )


def priority_score() -> Column:
    """Score of a queued record, from its decision, criteria, what can be read of it, age and type."""
    has = lambda c: blank_to_null(F.col(c)).isNotNull()
    return (
        F.when(F.col("decision") == "include", 100).when(F.col("decision") == "maybe", 50).otherwise(0)
        + 5 * count_criteria(F.col("matched_ic"))
        + F.when(has("abstract"), 8).otherwise(0)
        + F.when(has("oa_url"), 5).when(has("doi"), 3).when(has("url"), 1).otherwise(0)
        + F.when(F.col("year") >= 2020, 5).when(F.col("year") >= 2018, 3).when(F.col("year") >= 2015, 1).otherwise(0)
        + F.when(F.lower("doc_type").isin("article", "review"), 3).otherwise(0)
    )


def priority_band() -> Column:
    include = F.col("decision") == "include"
    return F.when(include & (F.col("score") >= 120), "A").when(include, "B").when(blank_to_null(F.col("abstract")).isNotNull(), "C").when(count_criteria(F.col("matched_ic")) > 0, "D").otherwise("E")


def priority_group() -> Column:
    file = F.lower(F.coalesce("pdf_status", F.lit(""))).isin("downloaded", "oa_found")
    return F.when(blank_to_null(F.col("oa_url")).isNotNull() | file, 1).when(blank_to_null(F.col("doi")).isNotNull(), 2).when(F.col("band") == "D", 3).when(F.col("band") == "E", 4).otherwise(5)


def relevant(text: Column, *term_lists) -> Column:
    """At least one term of each list is in the text."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [reduce(lambda x, y: x | y, [F.contains(low, F.lit(t)) for t in terms]) for terms in term_lists])


def _test(text):
    return text.rlike if isinstance(text, Column) else text


def first_match(text, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule (label, pattern) that matches a text (or by a function from pattern to condition)."""
    test = _test(text)
    return reduce(lambda rest, r: F.when(test(r[1]), r[0]).otherwise(rest), reversed(rules), F.lit(otherwise))


def all_matches(text, rules: list[tuple[str, str]]) -> Column:
    """The labels of all rules that match a text (or by a function from pattern to condition), in order."""
    test = _test(text)
    return F.array_compact(F.array(*(F.when(test(p), F.lit(label)) for label, p in rules)))


def clusters(df: DataFrame, rules: dict[str, tuple[list[str], list[str]]], column: str = "matched_ic", members: dict[str, list] | None = None, key: str = "id") -> DataFrame:
    """A row for each cluster whose wanted criteria are all matched and unwanted ones are not.

    ``members``: clusters given by the ids of their rows instead, lists made by hand.
    """
    labels = [F.when(F.col(key).isin(ids), F.lit(label)) for label, ids in (members or {}).items()]
    for label, (wanted, unwanted) in rules.items():
        test = reduce(lambda a, b: a & b, [F.contains(column, F.lit(w)) for w in wanted] + [~F.contains(column, F.lit(u)) for u in unwanted], F.lit(True))
        labels.append(F.when(test, F.lit(label)))
    return df.withColumn("cluster", F.explode(F.array_compact(F.array(*labels))))


def vocabulary_warnings(fields: dict[str, list[str]]) -> Column:
    """What is wrong with fields that take values of a vocabulary: missing or not in it."""
    found = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")).when(~F.col(f).isin(*allowed), F.concat(F.lit(f"invalid {f}: "), F.col(f))) for f, allowed in fields.items()]
    return F.array_compact(F.array(*found))


def valid_decisions(rows: DataFrame, column: str = "decision", domain: tuple[str, ...] = ("include", "exclude", "maybe")) -> DataFrame:
    """Rows whose decision, stripped and in small letters, is one of a domain; it is written back in that form."""
    said = F.lower(F.trim(column))
    return rows.filter(said.isin(*domain)).withColumn(column, said)
