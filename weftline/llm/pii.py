"""Personal data: fixed patterns, and identifiers found through their contexts.

Only DataFrame and SQL functions run here.  Positions come from the pieces that
``split`` leaves between the matches of ``regexp_extract_all``: both walk the
same leftmost non-overlapping matches, and lengths count code points.

The fixed patterns give *seeds*.  The words beside seeds, and beside other words
with a digit or an ``@`` (*candidates*), are patterns, and form a graph of
patterns and instances.  Each round scores a pattern by the share and number of
known instances of one kind among all instances it stands beside, and then a
candidate by the patterns that passed; candidates of high confidence under
several patterns become instances of that kind for good and take part in the next
round, until a round adds none.  Their places are added to the spans; spans of
the fixed patterns always stay.

The possessive forms below match what the plain ones do, but in linear time and
without recursion, so very long texts and runs are safe.

Defined cases: null and empty texts have no span; repeated rows each have their
own; a null id is kept; ties are ordered by start, kind and end; an empty table
gives an empty result; other columns are ignored (or, in :func:`redact`, kept).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import save, work_dir

# fixed values: the kinds in their order, and what each pattern is
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
BLOCK = 128
CONTEXT_CHARS = 40
LONG = 64  # longer candidates are known by their hash
SPAN = "struct<s:int,e:int,v:string,l:string,r:string>"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(v: str) -> str:
    digit = "int(substring(d, length(d) - i + 1, 1))"
    total = f"aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 0, 2 * {digit} - if({digit} > 4, 9, 0), {digit}))"
    return f"exists(array({_digits(v)}), d -> length(d) between 14 and 19 and {total} % 10 = 0)"


def _byte_parts(v: str) -> str:
    part = "trim(leading '0' from p)"
    return f"forall(split({v}, '[.]'), p -> length({part}) < 3 or length({part}) = 3 and {part} <= '255')"


#: kind -> (pattern, a cheap sign that a text may hold it, what a match must satisfy)
RULES = {
    "email": (EMAIL, "contains(text, '@')", lambda v: "true"),
    "ip": (IP, r"text rlike '[0-9]\\.[0-9]'", _byte_parts),
    "card": (CARD, "text rlike '[0-9]'", _luhn),
    "phone": (PHONE, "contains(text, '+')", lambda v: f"length({_digits(v)}) between 10 and 15"),
    "": (CANDIDATE, "text rlike '[0-9@]'", lambda v: f"length({v}) >= 4"),
}


def located(pattern: str, sign: str, accept) -> F.Column:
    """Accepted matches in the column ``text`` as an array of SPAN, with the words beside each.

    Matches are walked in blocks, so that appending to an array stays cheap.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    left = f"lower(regexp_extract(right(x.g, {CONTEXT_CHARS}), '(\\\\S*)\\\\s*$', 1))"
    right = f"lower(regexp_extract(left(x.h, {CONTEXT_CHARS}), '^\\\\s*(\\\\S*)', 1))"
    end = "a.p + length(x.g)"
    none = f"cast(array() as array<{SPAN}>)"
    span = f"named_struct('s', {end}, 'e', {end} + length(x.m), 'v', x.m, 'l', {left}, 'r', {right})"
    inner = f"""aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}), named_struct('p', acc.p, 'o', {none}),
        (a, x) -> named_struct('p', {end} + length(x.m), 'o', if({accept("x.m")}, concat(a.o, array({span})), a.o)),
        a -> named_struct('p', a.p, 'o', concat(acc.o, a.o)))"""
    walk = f"""aggregate(sequence(0, (size(z) - 1) div {BLOCK}), named_struct('p', 0, 'o', {none}), (acc, b) -> {inner}, acc -> acc.o)"""
    parts = f"named_struct('g', split(text, '{p}', -1), 'm', regexp_extract_all(text, '{p}', 0))"
    zipped = "zip_with(zip_with(slice(w.g, 1, size(w.m)), w.m, (g, m) -> named_struct('g', g, 'm', m)), slice(w.g, 2, size(w.m)), (y, h) -> named_struct('g', y.g, 'm', y.m, 'h', h))"
    bound = f"transform(transform(array({parts}), w -> {zipped}), z -> if(size(z) = 0, {none}, {walk}))[0]"
    return F.expr(f"if({sign}, {bound}, {none})")


@dataclass(frozen=True)
class Settings:
    least_instances: int = 3  # different known values beside a pattern
    pattern_confidence: float = 0.8
    least_patterns: int = 2  # different patterns beside a candidate
    instance_confidence: float = 0.95


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) and: ``base`` spans of all kinds, ``candidates`` not overlapping them."""
    for kind in KINDS:
        docs = docs.withColumn(f"__{kind}", located(*RULES[kind]))
    docs = docs.withColumn("__other", located(*RULES[""]))
    tagged = [f"transform(`__{k}`, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, 'v', x.v, 'l', x.l, 'r', x.r))" for i, k in enumerate(KINDS)]
    out = docs.withColumn("base", F.expr(f"array_sort(concat({', '.join(tagged)}))"))
    out = out.withColumn("candidates", F.expr("if(size(`__other`) = 0, `__other`, filter(`__other`, x -> not exists(base, y -> y.s < x.e and x.s < y.e)))"))
    key = f"if(length(x.v) > {LONG}, sha2(x.v, 256), x.v)"
    out = out.withColumn("candidates", F.expr(f"transform(candidates, x -> named_struct('s', x.s, 'e', x.e, 'v', {key}, 'l', x.l, 'r', x.r))"))
    return out.drop("__other", *[f"__{k}" for k in KINDS])


def _edges(found: DataFrame) -> DataFrame:
    """(pattern, value, kind): each pair once; kind null for candidates."""
    seeds = found.select(F.explode("base").alias("x")).select("x.v", "x.l", "x.r", F.col("x.k").alias("kind"))
    rest = found.select(F.explode("candidates").alias("x")).select("x.v", "x.l", "x.r", F.lit(None).cast("int").alias("kind"))
    every = seeds.union(rest)
    patterns = F.explode(F.array(F.concat(F.lit("<"), "l"), F.concat(F.lit(">"), "r"), F.concat(F.lit("<"), "l", F.lit(" >"), "r")))
    return every.select("v", "kind", patterns.alias("pattern")).where("length(pattern) > 1").distinct()


def discovered(found: DataFrame, s: Settings, folder: str) -> DataFrame:
    """(v, kind) of candidate values that the bootstrapping accepts."""
    edges = save(_edges(found), f"{folder}/edges")
    known, size = None, 0
    for k in count():
        e = edges
        if known is not None:
            e = edges.join(known.withColumnRenamed("kind", "learned"), "v", "left").select("pattern", "v", F.coalesce("kind", "learned").alias("kind"))
        counts = [F.sum((F.col("kind") == i).cast("long")).alias(f"k{i}") for i in range(len(KINDS))]
        scored = e.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(c, F.lit(0)).alias(f"k{i}") for i, c in enumerate(counts)])
        best = F.array_max(F.array(*[F.struct(F.col(f"k{i}").alias("seen"), F.lit(-i).alias("at")) for i in range(len(KINDS))]))
        scored = scored.withColumn("best", best).select("pattern", (-F.col("best.at")).alias("as"), F.col("best.seen").alias("seen"), (F.col("best.seen") / F.col("n")).alias("confidence"))
        passed = save(scored.where((F.col("seen") >= s.least_instances) & (F.col("confidence") >= s.pattern_confidence)), f"{folder}/patterns-{k}")
        votes = edges.where("kind is null").join(passed, "pattern").groupBy("v", "as").agg(F.count(F.lit(1)).alias("n"), (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        votes = votes.where((F.col("n") >= s.least_patterns) & (F.col("score") >= s.instance_confidence))
        before, known = known, votes.groupBy("v").agg(F.max(F.struct("score", (-F.col("as")).alias("at"))).alias("b")).select("v", (-F.col("b.at")).alias("kind"))
        if before is not None:
            known = before.union(known.join(before, "v", "left_anti"))
        known = save(known, f"{folder}/known-{k}")
        # known values only grow, so an equal number is an equal set
        n = known.count()
        if n == size:
            return known
        size = n


def _with_added(docs: DataFrame, id_col: str, s: Settings, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans`` (both sorted arrays of s, k, e)."""
    folder = work_dir(docs.sparkSession, "pii")
    found = base_spans(docs).withColumn("__key", F.xxhash64("text")).withColumn("__id", F.col(f"`{id_col}`").cast("long"))
    found = save(found.select("__id", "__key", "base", "candidates", *[F.col(f"`{c}`").alias(f"in_{c}") for c in keep]), f"{folder}/found")
    known = discovered(found, s, folder)
    places = found.where(F.size("candidates") > 0).select("__id", "__key", F.explode("candidates").alias("x")).select("__id", "__key", "x.v", "x.s", "x.e")
    added = places.join(known, "v").groupBy("__id", "__key").agg(F.collect_set(F.struct("s", F.col("kind").alias("k"), "e")).alias("added"))
    added = added.select(F.col("__id").alias("a_id"), F.col("__key").alias("a_key"), "added")
    out = found.join(added, F.col("__id").eqNullSafe(F.col("a_id")) & (F.col("__key") == F.col("a_key")), "left")
    plain = F.expr("transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))")
    spans = F.when(F.col("added").isNull(), plain).otherwise(F.array_sort(F.concat(plain, "added")))
    return out.select("__id", *[F.col(f"in_{c}").alias(c) for c in keep], plain.alias("base"), spans.alias("spans"))


def _joined(spans: str) -> F.Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def personal_data(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind of the fixed patterns, a digest of their spans, and all spans, for every row."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = _with_added(src, "doc_id", settings, [])
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("__id").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; overlapping spans are one."""
    given = docs.columns
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)]).withColumn("text", F.coalesce(F.col(f"c{given.index(text_col)}"), F.lit("")))
    keep = [f"c{i}" for i in range(len(given))]
    out = _with_added(src.withColumn("doc_id", F.col(f"c{given.index(id_col)}")), "doc_id", settings, keep)
    t = f"c{given.index(text_col)}"
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    body = f"""aggregate(spans, named_struct('o', '', 'p', 0),
        (a, x) -> if(x.s < a.p, named_struct('o', a.o, 'p', greatest(a.p, x.e)),
            named_struct('o', concat(a.o, substring({t}, a.p + 1, x.s - a.p), array({names})[x.k]), 'p', x.e)),
        a -> concat(a.o, substring({t}, a.p + 1)))"""
    masked = F.when(F.size("spans") == 0, F.col(t)).otherwise(F.expr(body))
    return out.select(*[(masked if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(given)])
