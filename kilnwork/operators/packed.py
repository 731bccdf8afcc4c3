"""Single fields that hold several values: infer the delimiters of each source, then split and explode with position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.sources.bounds import small
from kilnwork.sources.staging import stage

#: Candidate delimiters, name -> regular expression. A slash separates only between blanks.
DELIMITERS = {
    "comma": ",", "semicolon": ";", "bar": r"\|", "tab": r"\t", "line": r"[\r\n]", "wide_comma": "，", "wide_semicolon": "；",
    "ideographic_comma": "、", "bullet": "•", "slash": r"(?<=\s)/(?=\s)",
}

_PLACE = r",;|\t\r\n，；、•"
_CLOSES = rf"(?=\s*(?:[{_PLACE}/\]]|$))"
#: Quoted values, without alternatives in their loops, so their length is free. A quote that no place follows belongs to the value.
_DOUBLE = r'"[^"\\]*+(?:(?:\\[\s\S]|"")[^"\\]*+)*+"'
_SINGLE = rf"'[^'\\]*+(?:(?:\\[\s\S]|''|'(?!\s*(?:[{_PLACE}/\]]|$)))[^'\\]*+)*+'"
#: Groups: the place before a quoted value, blanks of any number, the value with its quotes.
_QUOTED = rf"(^|[{_PLACE}/\[])(\s*+)({_DOUBLE}|{_SINGLE}){_CLOSES}"
#: Characters of delimiters, and private-use twins that stand for them inside quoted values.
_MARKS = ",;|\t\r\n，；、•/"
_TWINS = "".join(chr(0xE010 + i) for i in range(len(_MARKS)))
#: Private-use characters: in place of a quoted value, around one that is put back, and before one that stood in the data.
_HIDDEN, _FROM, _TO, _ESCAPE = "\ue000", "\ue001", "\ue002", "\ue003"
_OWN = _ESCAPE + _HIDDEN + _FROM + _TO + _TWINS


#: White space of any kind (fixed values).
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def _unquoted(c: Column) -> Column:
    """The value of a quoted span: escapes and doubled quotes restored."""
    inside = F.substring(c, F.lit(2), F.length(c) - 2)
    double = F.when(
        inside.contains("\\"),
        F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"), F.regexp_replace(inside, r"\\(.)", "$1")),
    ).otherwise(F.replace(inside, F.lit('""'), F.lit('"')))
    single = F.replace(F.regexp_replace(inside, r"\\(.)", "$1"), F.lit("''"), F.lit("'"))
    return F.when(c.startswith('"'), double).otherwise(single)


def _body(c: Column) -> Column:
    """The field without blanks and one pair of brackets around it; characters of the data that are used here are escaped."""
    s = _strip(c)
    s = F.when(s.startswith("[") & s.endswith("]"), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    escaped = reduce(lambda e, i: F.replace(e, F.lit(_OWN[i]), F.lit(_ESCAPE + chr(ord("a") + i))), range(len(_OWN)), s)
    return F.when(s.rlike(f"[{_OWN}]"), escaped).otherwise(s)


def _restored(c: Column) -> Column:
    """A value with what _body escaped."""
    plain = reduce(lambda e, i: F.replace(e, F.lit(_ESCAPE + chr(ord("a") + i)), F.lit(_OWN[i])), reversed(range(len(_OWN))), c)
    return F.when(c.contains(_ESCAPE), plain).otherwise(c)


def _quotes(body: Column) -> Column:
    """The quoted values of a body, bare."""
    return F.transform(F.regexp_extract_all(body, F.lit(_QUOTED), F.lit(3)), _unquoted)


def _shape(piece: Column) -> Column:
    """The type of a piece: words, numbers and capitals as one sign each, other signs as they are."""
    words = F.regexp_replace(piece, r"[\p{L}\p{M}&.'’\-]+(?:\s+[\p{L}\p{M}&.'’\-]+)*+", "w")
    return F.substring(F.regexp_replace(words, r"[0-9]+", "9"), 1, 12)


def _cutter(names: tuple[str, ...]) -> str:
    """One pattern of the named delimiters: a class of those that are one sign, and the others."""
    single = [DELIMITERS[n] for n in names if n not in ("line", "slash")]
    parts = [f"[{''.join(single)}{DELIMITERS['line'][1:-1] if 'line' in names else ''}]"] if single or "line" in names else []
    return "|".join(parts + [DELIMITERS[n] for n in names if n == "slash"])


def _pieces(skeleton: Column, names: tuple[str, ...]) -> Column:
    """Non-empty pieces of a skeleton cut at the named delimiters."""
    cut = F.split(skeleton, _cutter(names)) if names else F.array(skeleton)
    return F.filter(F.transform(cut, _strip), lambda p: p != "")


def _signature(skeleton: Column) -> Column:
    """Names of the candidates that occur outside quotes, as one string."""
    plain = {n: x.removeprefix("\\") for n, x in DELIMITERS.items() if len(x.removeprefix("\\")) == 1 and n != "tab"} | {"tab": "\t"}
    has = lambda n, x: skeleton.contains(plain[n]) if n in plain else skeleton.rlike(x)
    return F.concat_ws(" ", *[F.when(has(n, x), F.lit(n)) for n, x in DELIMITERS.items()])


def _skeleton(body: Column) -> Column:
    """The body with every quoted value hidden; only a field with quotes is searched."""
    return F.when(body.contains('"') | body.contains("'"), F.regexp_replace(body, _QUOTED, f"$1$2{_HIDDEN}")).otherwise(body)


def infer_delimiters(df: DataFrame, value: str, source: str | None = None) -> DataFrame:
    """The delimiters of each source: columns source, signature, delimiters (space-separated names), score.

    The source is a column of df or, where it has none, the hand that packed the field, told by which candidates occur
    outside quotes. Options for a source are all its candidates, all but one, each alone, and none. An option's score is
    0.8 times the regularity of its pieces plus 0.2 times the consistency of their counts (1 / (1 + deviation / mean)). A piece
    that is known as a single value (a quoted one, or a piece of a field with one candidate only) counts 1; another one counts half the
    share that its type (`_shape`) has among single values, relative to the commonest type. Of equal options the one with more
    delimiters wins. Nulls and blanks have no signature and no row. Only sums per source and option are shuffled, and distinct
    pieces for the lookup of known values.
    """
    own = F.col(source).cast("string") if source else F.lit("")
    rows = (
        df.select(own.alias("source"), _body(F.col(value)).alias("body")).where(F.col("body") != "")
        .groupBy("source", "body").agg(F.count("*").alias("n"))
        .withColumn("skeleton", _skeleton(F.col("body")))
        .withColumn("signature", _signature(F.col("skeleton")))
    )
    rows = stage(rows, "packed")
    single = F.coalesce(*[F.when(F.col("signature") == n, _pieces(F.col("skeleton"), (n,))) for n in DELIMITERS],
                        F.when(F.col("signature") == "", F.array("skeleton")), F.array().cast("array<string>"))
    known = (
        rows.select(F.explode(F.concat(F.when(F.col("skeleton").contains(_HIDDEN), _quotes(F.col("body"))).otherwise(F.array().cast("array<string>")), single)).alias("piece"), "n")
        .where(~F.col("piece").contains(_HIDDEN)).groupBy("piece").agg(F.sum("n").alias("known")).withColumn("shape", _shape(F.col("piece")))
    )
    known = stage(known, "known")
    shapes = known.groupBy("shape").agg(F.sum("known").alias("usual"))
    number, kinds = known.agg(F.count("*"), F.count_distinct("shape")).first()
    most = shapes.agg(F.max("usual")).first()[0] or 1
    mixed = rows.where(F.col("signature") != "")
    signatures = [r[0] for r in mixed.select("signature").distinct().limit(2 ** len(DELIMITERS)).collect()]  # at most as many subsets
    tried = []
    for s in signatures:
        names = tuple(s.split(" "))
        options = dict.fromkeys([names, *[tuple(x for x in names if x != n) for n in names], *[(n,) for n in names], ()])
        tried.append(
            F.when(F.col("signature") == s, F.array(*[F.struct(F.lit(" ".join(o)).alias("option"), F.lit(len(o)).alias("size"), _pieces(F.col("skeleton"), o).alias("pieces")) for o in options]))
        )
    if not tried:
        return rows.select("source", "signature", F.lit("").alias("delimiters"), F.lit(1.0).alias("score")).distinct()
    cut = mixed.select("source", "signature", "n", F.explode(F.coalesce(*tried)).alias("o")).select("source", "signature", "n", "o.*").withColumn("count", F.size("pieces").cast("double"))
    option = ["source", "signature", "option", "size"]
    # every sum of an option is one over its pieces: their number, the fields they are of, the squares of the fields' numbers
    seen = cut.select(*option, "n", "count", F.explode("pieces").alias("piece")).groupBy(*option, "piece").agg(
        F.sum("n").alias("pieces"), F.sum(F.col("n") / F.col("count")).alias("fields"), F.sum(F.col("n") * F.col("count")).alias("squares")
    )
    typed = seen.join(small(known.select("piece", "known"), number), "piece", "left").withColumn("shape", _shape(F.col("piece"))).join(small(shapes, kinds), "shape", "left")
    hidden = F.col("piece").contains(_HIDDEN) & (F.length("piece") == 1)
    regular = F.when(F.col("known").isNotNull() | hidden, 1.0).otherwise(0.5 * F.coalesce(F.col("usual") / most, F.lit(0.0)))
    sums = typed.groupBy(*option).agg(F.sum(F.col("pieces") * regular).alias("regular"), *[F.sum(c).alias(c) for c in ("pieces", "fields", "squares")])
    mean = F.col("pieces") / F.col("fields")
    deviation = F.sqrt(F.greatest(F.col("squares") / F.col("fields") - mean * mean, F.lit(0.0)))
    score = 0.8 * F.col("regular") / F.col("pieces") + 0.2 / (1 + deviation / mean)
    best = sums.withColumn("score", F.round(score, 9)).groupBy("source", "signature").agg(F.max(F.struct("score", "size", "option")).alias("b"))
    return best.select("source", "signature", F.col("b.option").alias("delimiters"), F.col("b.score").alias("score"))


def split_packed(df: DataFrame, value: str, keep: list[str], source: str | None = None, pos: str = "pos", out: str = "value") -> DataFrame:
    """One row per single value of a packed field, with its place: the columns `keep`, then pos (int, from 0) and out.

    Null, blank and delimiter-only fields give no row; empty places give no row and take no position. What stands inside
    quotes is one value, with escapes and doubled quotes restored; brackets around the whole field are dropped. A value that
    occurs twice gives two rows; a repeated input row gives its rows again. Other columns of df are left out, so none can clash.
    """
    own = F.col(source).cast("string") if source else F.lit("")
    chosen = stage(infer_delimiters(df, value, source), "delimiters")
    sets = [r[0] for r in chosen.select("delimiters").distinct().limit(2 ** len(DELIMITERS)).collect()]
    rows = (
        df.select(*keep, own.alias("__source"), _body(F.col(value)).alias("__body")).where(F.col("__body") != "")
        .withColumn("__skeleton", _skeleton(F.col("__body"))).withColumn("__signature", _signature(F.col("__skeleton")))
        .join(small(chosen.select(F.col("source").alias("__source"), F.col("signature").alias("__signature"), "delimiters"), chosen.count()), ["__source", "__signature"], "left")
    )
    skeleton = F.col("__skeleton")

    def pieces(field: Column) -> Column:
        cuts = [F.when(F.col("delimiters") == s, F.split(field, _cutter(tuple(s.split(" "))))) for s in sets if s]
        return F.transform(F.coalesce(*cuts, F.array(field)), _strip)

    def shown(piece: Column) -> Column:
        """A stripped piece with its quoted values bare again; one that is a quoted value alone loses its own outer blanks."""
        bare = F.translate(piece, _TWINS + _FROM + _TO, _MARKS)
        return _restored(F.when(piece.startswith(_FROM) & piece.endswith(_TO), _strip(bare)).otherwise(bare))

    plain = F.transform(F.filter(pieces(skeleton), lambda p: p != ""), _restored)
    # quoted values go back in with twins in place of delimiters, so that no cut falls into them
    guarded = F.transform(_quotes(F.col("__body")), lambda q: F.concat(F.lit(_FROM), F.translate(q, _MARKS, _TWINS), F.lit(_TO)))
    filled = F.array_join(F.zip_with(F.split(skeleton, _HIDDEN), guarded, lambda b, q: F.concat(b, F.coalesce(q, F.lit("")))), "")
    quoted = F.filter(F.transform(pieces(filled), shown), lambda p: p != "")
    values = rows.select(*keep, F.when(skeleton.contains(_HIDDEN), quoted).otherwise(plain).alias("__values"))
    return values.select(*keep, F.posexplode("__values").alias(pos, out))
