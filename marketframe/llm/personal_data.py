"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds. E-mail addresses, IP addresses, payment cards (Luhn) and telephone
numbers are found by regular expressions; matches that fail their test are
dropped without another try. Positions come from the pieces between matches.

Bootstrapping. Every other token with a digit is a candidate instance. The words
around an instance give lexical patterns: the two words to its left, the word to
its left with the shape of the instance, and the words on both sides. Seeds and
candidates form a bipartite graph of instances and patterns. In each round a
pattern's confidence for a kind is the mean confidence of its distinct
instances, less a margin for small support, and an instance's confidence is the
noisy-or of its confident patterns. After the last round, candidates in a
pattern of high confidence become spans of its kind (unseen identifiers).

The regular expressions use possessive repeats and may only start where a match
can start, so long runs cost linear time and no stack. The words around an
instance, seed or candidate, are those of the text whatever they hold.

Defined cases: null counts as the empty text; a text without a span has the
digest of the empty string and empty ``spans``; spans of different kinds may
overlap; found spans never overlap base spans; null ids and repeated rows are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 3       # distinct instances that back a pattern
CONFIDENT = 0.6       # of a pattern that passes confidence on
ACCEPT = 0.8          # of a pattern that yields spans
BLOCK = 64

# A match starts at the end of the match before it, or where the character to
# the left could not have been part of it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
PATTERNS = {"email": (EMAIL, "@"), "ip": (IP, r"[0-9]\.[0-9]"), "card": (CARD, r"[0-9][\x20-]?[0-9]"), "phone": (PHONE, r"\+[0-9]")}

SPAN = "array<struct<start:long,end:long,value:string,l2:string,l1:string,r1:string>>"


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """All matches with their code point spans and the words around them."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.when(possible, F.struct(found.alias("m"), pieces.alias("p")))


def located(raw: str, near: int) -> str:
    """SQL of the spans of a ``matches`` column: running sums over blocks of
    lengths, so that a text with many matches does not cost their square. The
    words around a match are those of the text, with up to ``near`` other
    matches to each side."""
    before = (f"concat(array_join(zip_with(slice({raw}.p, greatest(i - {near}, 0) + 1, least(i, {near})), slice({raw}.m, greatest(i - {near}, 0) + 1, "
              f"least(i, {near})), (p, q) -> concat(right(p, 100), right(q, 100))), ''), right({raw}.p[i], 100))")
    after = (f"concat(left({raw}.p[i + 1], 100), array_join(zip_with(slice({raw}.m, i + 2, {near}), slice({raw}.p, i + 3, {near}), "
             "(q, p) -> concat(left(q, 100), left(p, 100))), ''))")
    size = f"transform({raw}.m, (m, i) -> cast(char_length(m) + char_length({raw}.p[i]) as long))"
    word = r"[^\\s]+"
    return f"""
    CASE WHEN {raw} IS NULL OR size({raw}.m) = 0 THEN cast(array() AS {SPAN}) ELSE
    transform(array({size}), z -> transform(array(aggregate(
        transform(sequence(0, cast((size(z) - 1) / {BLOCK} as int)), b -> aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}), 0L, (s, x) -> s + x)),
        array(0L), (acc, x) -> concat(acc, array(acc[size(acc) - 1] + x)))),
      starts -> transform({raw}.m, (m, i) -> transform(array(
          starts[cast(i / {BLOCK} as int)] + IF(i % {BLOCK} = 0, 0L, aggregate(slice(z, cast(i / {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK}), 0L, (s, x) -> s + x))
          + char_length({raw}.p[i])),
        at -> transform(array(struct(right({before}, 100) AS l, left({after}, 100) AS r)), w -> struct(
                     at AS start, at + char_length(m) AS end, m AS value,
                     regexp_extract(w.l, r'(\\S+)\\s+\\S+\\s*$', 1) AS l2,
                     regexp_extract(w.l, r'(\\S+)\\s*$', 1) AS l1,
                     regexp_extract(w.r, r'^\\s*(\\S+)', 1) AS r1))[0])[0]))[0])[0] END""".replace("\\\\", "\\")


VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), q -> char_length(ltrim('0', q)) <= 3 AND coalesce(cast(nullif(ltrim('0', q), '') as int), 0) <= 255)",
    "card": """exists(array(regexp_replace(x.value, '[^0-9]', '')), d -> char_length(d) BETWEEN 13 AND 19 AND
        aggregate(sequence(1, char_length(d)), 0, (s, i) -> s + IF(i % 2 = 1, 1, 0) * cast(substr(d, char_length(d) + 1 - i, 1) as int)
        + IF(i % 2 = 0, 1, 0) * ((2 * cast(substr(d, char_length(d) + 1 - i, 1) as int)) % 10
        + IF(cast(substr(d, char_length(d) + 1 - i, 1) as int) >= 5, 1, 0))) % 10 = 0)""",
    "phone": "char_length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, other): valid matches of the four kinds, and the
    tokens with a digit (four characters or more) that overlap none of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    for kind, (pattern, hint) in PATTERNS.items():
        possible = F.contains("text", F.lit("@")) if kind == "email" else F.col("text").rlike(hint)
        rows = rows.withColumn(f"m_{kind}", matches(F.col("text"), pattern, possible))
    rows = rows.withColumn("m_token", matches(F.col("text"), TOKEN, F.col("text").rlike("[0-9]")))
    rows = rows.select("doc_id", "key", *[F.expr(located(f"m_{k}", near)).alias(k) for k, near in (*((k, 50) for k in KINDS), ("token", 2))])
    base = ", ".join(f"transform(filter({k}, x -> {VALID[k]}), x -> named_struct('kind', {i}, 'start', x.start, 'end', x.end, "
                     f"'value', x.value, 'l2', x.l2, 'l1', x.l1, 'r1', x.r1))" for i, k in enumerate(KINDS))
    return (rows.select("doc_id", "key", "token", F.expr(f"concat({base})").alias("base"))
            .select("doc_id", "key", "base", F.expr(
                "filter(token, x -> char_length(x.value) >= 4 AND NOT exists(base, b -> b.start < x.end AND x.start < b.end))").alias("other")))


def edges_of(spans: DataFrame) -> DataFrame:
    """One row per span and pattern: adds ``pattern`` and ``instance``."""
    def norm(c: str) -> str:
        return f"lower(regexp_replace({c}, '[^\\\\p{{L}}\\\\p{{N}}:#@]', ''))"
    shape = "regexp_replace(regexp_replace(value, '[A-Za-z]+', 'a'), '[0-9]+', '9')"
    trimmed = "lower(regexp_replace(value, '^[^\\\\p{L}\\\\p{N}+]+|[^\\\\p{L}\\\\p{N}]+$', ''))"
    named = spans.withColumns({"a": F.expr(norm("l2")), "b": F.expr(norm("l1")), "c": F.expr(norm("r1")),
                               "instance": F.expr(trimmed), "shape": F.expr(shape)})
    return named.withColumn("pattern", F.explode(F.expr(
        "filter(array(IF(a != '' AND b != '', concat('ll ', a, ' ', b), NULL), IF(b != '', concat('ls ', b, ' ', shape), NULL), "
        "IF(b != '' AND c != '', concat('lr ', b, ' ', c), NULL)), x -> x IS NOT NULL)"))).drop("a", "b", "c", "shape")


def bootstrap(facts: DataFrame) -> DataFrame:
    """(key, kind, start, end) of candidates that confident patterns discover."""
    seeds = facts.select("key", F.explode("base").alias("s")).select("key", "s.*")
    others = facts.select("key", F.explode("other").alias("s")).select("key", F.lit(None).cast("int").alias("kind"), "s.*")
    edges = stored(edges_of(seeds.unionByName(others)), "edges")
    # patterns that hold several distinct instances; the others can back nothing
    graph = edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    wide = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT)
    graph = stored(graph.join(wide, "pattern"), "graph")
    belief = graph.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("conf")).distinct()
    scores = None
    for r in range(ROUNDS):
        held = graph.select("pattern", "n", "instance").join(belief, "instance")
        scores = (held.groupBy("pattern", "kind", "n").agg(F.sum("conf").alias("mass"))
                  .withColumn("conf", F.col("mass") / (F.col("n") + 0.5))
                  .where((F.col("conf") >= CONFIDENT) & (F.col("mass") >= MIN_SUPPORT - 0.5)).select("pattern", "kind", "conf"))
        scores = stored(scores, "scores")
        if r + 1 == ROUNDS or scores.isEmpty():
            break
        reached = (graph.where("kind is null").select("pattern", "instance").join(scores, "pattern")
                   .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("conf")))
        belief = stored(graph.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("conf")).distinct()
                        .unionByName(reached), "belief")
    best = scores.where(F.col("conf") >= ACCEPT)
    return (edges.where("kind is null").drop("kind").join(best, "pattern")
            .groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind")))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found): base spans with their values, discovered spans."""
    facts = stored(base_spans(docs), "facts")
    found = bootstrap(facts).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    return facts.join(found, "key", "left").select(
        "doc_id", "base", F.coalesce("found", F.expr("cast(array() as array<struct<kind:int,start:long,end:long>>)")).alias("found"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    name = "element_at(array('email', 'ip', 'card', 'phone'), x.kind + 1)"
    text = f"transform({{}}, x -> concat({name}, ':', x.start, ':', x.end))"
    every = "array_sort(concat(transform(base, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end)), found))"
    return rows.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.array_join(F.expr(text.format("base")), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(text.format(every)), ",").alias("spans"))
