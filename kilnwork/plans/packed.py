"""Queries of the packed-field operator over business.categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.operators.packed import infer_delimiters, split_packed
from kilnwork.plans.registry import Registry
from kilnwork.sources.tables import table

_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARKS = r",;|\t\r\n，；、•"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


#: The same rows by another way: pieces are cut off one by one from the left, quoted ones where a delimiter or the end follows. It knows the
#: delimiters beforehand: those that p3_delimiters must infer for each hand.
_SQL = f"""
WITH s AS (SELECT DISTINCT business_id, {_stripped("categories")} c FROM business WHERE categories IS NOT NULL),
b AS (SELECT business_id, CASE WHEN c LIKE '[%]' THEN c[2:-2] ELSE c END c FROM s),
t AS (SELECT business_id, list_transform(regexp_extract_all(c, '\\s*"(?:[^"\\\\]|\\\\.|"")*"\\s*(?:[{_MARKS}]|$)|\\s*''(?:[^''\\\\]|\\\\.|''[^{_MARKS}\\]''])*''\\s*(?:[{_MARKS}]|$)|[^{_MARKS}]*(?:[{_MARKS}]|$)'),
    lambda p: {_stripped(f"regexp_replace(p, '[{_MARKS}]$', '')")}) pieces FROM b),
v AS (SELECT business_id, list_filter(flatten(list_transform(pieces, lambda p: CASE
    WHEN length(p) > 1 AND p LIKE '"%"' AND contains(p, chr(92)) AND json_valid(p) THEN [{_stripped("p->>'$'")}]
    WHEN length(p) > 1 AND p LIKE '"%"' THEN [{_stripped("regexp_replace(replace(p[2:-2], '\"\"', '\"'), chr(92) || chr(92) || '(.)', chr(92) || '1', 'g')")}]
    WHEN length(p) > 1 AND p LIKE '''%''' THEN [{_stripped("replace(p[2:-2], '''''', '''')")}]
    ELSE list_transform(regexp_split_to_array(p, '\\s/\\s'), lambda q: {_stripped("q")}) END)), lambda p: p <> '') pieces FROM t)
"""


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "business").select("business_id", "categories").where(F.col("categories").isNotNull()).distinct()
    return split_packed(rows, "categories", ["business_id"], out="category").distinct()


def p3_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    """What was inferred for each hand that packed the fields."""
    return infer_delimiters(table(spark, folder, "business"), "categories").select("signature", "delimiters")


def register(out: Registry) -> None:
    out.add("p3_found", _SQL + "SELECT DISTINCT business_id, (unnest(generate_series(1, len(pieces))) - 1)::INTEGER pos, unnest(pieces) category FROM v WHERE len(pieces) > 0")(p3_found)
    # every candidate that is there outside quotes is a delimiter in these tables
    names = "comma , semicolon ; bar | tab \\t line \\n wide_comma ， wide_semicolon ； ideographic_comma 、 bullet •".split(" ")
    has = ", ".join(f"CASE WHEN contains(u, {'chr(9)' if m == chr(92) + 't' else 'chr(10)' if m == chr(92) + 'n' else repr(m)}) THEN '{n}' END" for n, m in zip(names[::2], names[1::2], strict=True))
    out.add(
        "p3_delimiters",
        f"""WITH s AS (SELECT DISTINCT {_stripped("categories")} c FROM business WHERE categories IS NOT NULL),
        b AS (SELECT CASE WHEN c LIKE '[%]' THEN c[2:-2] ELSE c END c FROM s),
        h AS (SELECT replace(regexp_replace(c, '(^|[{_MARKS}/\\[])(\\s*)(?:"(?:[^"\\\\]|\\\\.|"")*"|''(?:[^''\\\\]|''[^{_MARKS}\\]''])*'')', '\\1\\2', 'g'), chr(13), chr(10)) u FROM b WHERE c <> ''),
        n AS (SELECT concat_ws(' ', {has}, CASE WHEN regexp_matches(u, '\\s/\\s') THEN 'slash' END) signature FROM h)
        SELECT DISTINCT signature, signature delimiters FROM n WHERE signature <> ''""",
    )(p3_delimiters)
