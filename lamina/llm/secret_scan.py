"""Secret scans: patterns over whole texts, and weak candidates that count only beside their complements.

All of it is expressions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized_join, stored, text_id

#: The base kinds in order, each with its pattern. In the pattern's place (?i:) is for A-Z only.
_KEY = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _KEY + r"""["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{32,}+"
#: Weak by themselves: a mixed-case word of 20 or more characters with a digit, and a network address.
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"(?:https?|s3|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9@:._~%/?#=&+-]++"
KINDS = ("assign", "access", "hex", "weak_secret", "endpoint")
#: Identifiers of users, roles, groups and keys by their published prefixes. Like an access identifier they open a scope; they are no spans of their own.
_PREFIX = r"(?:A3T[A-Z0-9]|ABIA|ACCA|AGPA|AIDA|AIPA|AKIA|ANPA|ANVA|AROA|ASCA|ASIA)"
IDENTIFIER = rf"(?<![A-Za-z0-9]){_PREFIX}[A-Z0-9]{{12,}}+"
#: A scope reaches so many characters before and after an identifier or a secret.
REACH = 256
_SPAN = "array<struct<s:int,e:int>>"


def let(value: Column, body) -> Column:
    """body(value), value evaluated once: a lambda's argument is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Running sums of an array of ints, in blocks of the square root of its size: n^1.5 steps, no row of sums copied n times."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def over(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"), F.lit(1))
        return let(width, lambda w: let(F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / w).cast("int") - 1), lambda b: F.slice(xs, b * w + 1, w)), sums))

    def sums(blocks: Column) -> Column:
        return let(F.transform(blocks, total), lambda whole: F.flatten(F.transform(blocks, lambda block, b: let(total(F.slice(whole, F.lit(1), b)), lambda before: F.transform(block, lambda _, k: before + total(F.slice(block, F.lit(1), k + 1)))))))

    return let(lengths, lambda xs: F.when(F.size(xs) > 0, over(xs)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Spans (code points) of pattern's leftmost non-overlapping matches in text; those whose group has under `least` characters are dropped.

    Each match is taken together with the text since the one before, so that lengths add up to places."""
    whole = rf"(?s)\G(.*?)({pattern})"
    get = lambda k: F.regexp_extract_all(text, F.lit(whole), F.lit(k))
    size = lambda k: F.transform(get(k), lambda x: F.char_length(x))
    ends = running(size(0))
    # zip: end, the match's length, its group's length
    rows = F.arrays_zip(ends.alias("e"), size(2).alias("n"), (size(2 + group) if group else size(2)).alias("g"))
    return let(rows, lambda xs: F.transform(F.filter(xs, lambda x: x["g"] >= least), lambda x: F.struct((x["e"] - x["n"]).alias("s"), x["e"].alias("e"))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text (a number of the text) and an array of spans for each of KINDS and of identifier. Weak secrets are looked for in
    texts with an identifier, or with a base secret and an address; endpoints in texts with an identifier or a base secret: elsewhere
    nothing complements them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(_SPAN)
    some = lambda test, found: F.when(test, found).otherwise(none).cast(_SPAN)
    assign, access, hexes = text.rlike(_KEY + r"""["']?\x20*[:=]"""), F.contains(text, F.lit("AKIA")), text.rlike("[0-9a-f]{32}")
    named, address = access | text.rlike(IDENTIFIER), F.contains(text, F.lit("://"))
    return docs.select(
        F.col(id_col).alias("_id"), text_id(text).alias("_text"),
        some(assign, spans(text, ASSIGN, 8, 1)).alias("assign"),
        some(access, spans(text, ACCESS, 16)).alias("access"),
        some(hexes, spans(text, HEX, 32)).alias("hex"),
        some(named | (address & (assign | hexes)), spans(text, WEAK)).alias("weak_secret"),
        some(address & (named | assign | hexes), spans(text, ENDPOINT)).alias("endpoint"),
        some(named, spans(text, IDENTIFIER)).alias("identifier"),
    )


def _within(parts: DataFrame, scopes: DataFrame, reach: int) -> DataFrame:
    """Those parts that overlap a scope of the same text. Both are dealt by text and bin: a scope to each bin that it covers,
    a part to that of its start; a bin holds no more parts than fit in its characters."""
    width = 4 * max(reach, 64)
    scopes = scopes.select("_id", "_text", F.greatest(F.col("s") - reach, F.lit(0)).alias("_low"), (F.col("e") + reach).alias("_high"))
    scopes = scopes.select("*", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))).alias("_bin")).alias("y")
    parts = parts.withColumn("_bin", F.floor(F.col("s") / width)).alias("x")
    same = F.col("x._id").eqNullSafe(F.col("y._id")) & (F.col("x._text") == F.col("y._text")) & (F.col("x._bin") == F.col("y._bin"))
    return parts.join(scopes, same & (F.col("x.s") < F.col("y._high")) & (F.col("x.e") > F.col("y._low")), "left_semi").select("x.*").drop("_bin")


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """_id, _text, kind, s, e of the weak candidates that count, once each: a weak secret within reach of an identifier, or of an endpoint
    that is within reach of a base secret; and an endpoint within reach of a secret, weak ones of the first sort included. A weak
    candidate that overlaps a base span adds nothing."""
    named = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    rows = found.where((F.size("weak_secret") > 0) | (F.size("endpoint") > 0)).select("_id", "_text", F.explode(F.concat(*map(named, (*KINDS, "identifier")))).alias("x")).select("_id", "_text", "x.*").distinct()
    of = lambda *kinds: rows.where(F.col("kind").isin(*kinds))
    covered = _within(of("weak_secret"), of("assign", "access", "hex", "identifier"), 0)  # such a one is reported as what it is, or names no secret
    covered = covered.select(*(F.col(c).alias(f"_c{c}") for c in covered.columns))
    free = of("weak_secret").join(covered, [F.col(c).eqNullSafe(F.col(f"_c{c}")) for c in rows.columns], "left_anti")
    weak = _within(free, of("access", "identifier"), reach)
    known = _within(of("endpoint"), of("assign", "hex"), reach)
    ends = known.unionByName(_within(of("endpoint"), weak, reach))
    return weak.unionByName(_within(free, known, reach)).unionByName(ends).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """id, the numbers of base spans, base_spans and all spans: arrays of (kind, s, e), code points with e exclusive,
    by start and then KINDS' order.

    A null text is empty: it has no spans. Null ids are kept; repeated rows give a row each, and an empty table none. Texts
    of any length are scanned whole. Other columns are left out."""
    found = stored(candidates(docs, id_col, text_col), "secrets")
    added = stored(link(found, reach).groupBy(F.col("_id").alias("_id2"), "_text").agg(F.collect_list(F.struct("kind", "s", "e")).alias("_more")), "linked")
    none = F.lit(-1)
    key = F.struct(F.coalesce("_id", none).alias("i"), F.col("_id").isNull().alias("n"), "_text")
    left = found.withColumn("_key", F.to_json(key))
    right = added.select(F.to_json(F.struct(F.coalesce("_id2", none).alias("i"), F.col("_id2").isNull().alias("n"), "_text")).alias("_key"), "_more")
    rows = sized_join(left, right, ["_key"], "left")
    order = lambda s, kind, e: F.struct(s.alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("k"), e.alias("e"), kind.alias("kind"))
    tidy = lambda xs: F.transform(F.array_sort(xs), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    base = F.concat(*map(lambda kind: F.transform(kind, lambda x: order(x["s"], F.lit(kind), x["e"])), KINDS[:3]))
    more = F.coalesce(F.transform("_more", lambda x: order(x["s"], x["kind"], x["e"])), F.array().cast("array<struct<s:int,k:bigint,e:int,kind:string>>"))
    return rows.select(F.col("_id").alias(id_col), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), tidy(base).alias("base_spans"), tidy(F.concat(base, more)).alias("all_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
