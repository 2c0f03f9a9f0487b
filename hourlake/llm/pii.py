"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

The fixed patterns give the base spans of e-mail addresses, IP addresses, card and telephone
numbers. Matches come leftmost first and do not overlap within a kind; a match that fails its
check is dropped. The patterns are written so that Java's engine needs linear time: no run of
characters is tried from its middle, and repetitions give nothing back.

Seeds and candidates are the words that hold a digit or an @, and runs of digit groups parted
by spaces, brackets, dots or hyphens, which count as one. Those that a base pattern matches
whole, and passes, are seeds of its kind. Runs of 32, 40 or 64 lower-case hex digits are seeds
of one more kind, `secret`; since a digest need not be secret, such a seed becomes a span only
where a counting pattern says so. All others are candidates.

Lexical patterns are made of the words around an occurrence, whatever their length: the word
before with the word after, the two words before, and backed off to the word before, the word
after, and the shape of the two words before. Digits are masked. Patterns and instances (the
surface strings) form a graph, which is scored in rounds:

* a pattern's confidence in a kind is the belief of its distinct instances in that kind over
  their number and two more; it counts once `SUPPORT` believed instances back it and it
  reaches `CONFIDENT`;
* an instance is believed by 1 - product(1 - confidence) over its counting patterns; seeds
  are believed fully;
* rounds go on until no belief changes by more than `TOLERANCE`. Beliefs only rise, so they end.

Candidates believed enough whose characters suit the kind become further spans (of the kind
believed most, ties by name) at the places where a counting pattern of that kind holds them,
unless a base span is there. Base spans stay as they are.

Everything is DataFrame functions. Texts are read once, whole; later steps work on the spans.
Counts in the graph are aggregated by (pattern, instance) first, so a frequent context or
identifier is no burden.

Defined results: null and empty texts have no spans (base_sha256 is that of an empty text).
Repeated rows each get their own spans. Offsets count code points, ends are exclusive.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.llm.common import folder, stored

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"
#: Distinct believed instances and confidence that a pattern needs, belief an instance needs, change that ends the rounds.
SUPPORT, CONFIDENT, BELIEVED, TOLERANCE = 5, 0.8, 0.9, 0.001
#: Matches are placed in blocks of so many, so that long lists are not copied for every match.
BLOCK = 256

# The base patterns. A run is entered at its first character, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Telephone-like runs, runs of digit groups (20 at most, more than a number of 19 digits has), and words with a digit or an @.
CANDIDATE = (
    r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9A-Za-z@])[(]?[0-9]++(?:[\x20().-]{1,2}+[0-9]++(?![0-9A-Za-z@])){1,19}+|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
)
#: What around a word is not part of the identifier.
HEAD, TAIL = r"^[^A-Za-z0-9+]*?(?=[A-Za-z0-9+]|\([0-9]|$)", r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$"
SECRET_SEED = r"^(?=[0-9]*[a-f])(?=[a-f]*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
DIGITS = "regexp_replace(m.v, r'[^0-9]', '')"
LUHN = f"""aggregate(sequence(1, length({DIGITS})), 0, (sum, i) -> sum + (
  CASE WHEN i % 2 = 1 THEN int(substring({DIGITS}, -i, 1)) WHEN int(substring({DIGITS}, -i, 1)) < 5 THEN 2 * int(substring({DIGITS}, -i, 1))
       ELSE 2 * int(substring({DIGITS}, -i, 1)) - 9 END)) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": "forall(split(m.v, r'\\.'), p -> length(ltrim('0', p)) <= 3 AND (ltrim('0', p) = '' OR int(ltrim('0', p)) <= 255))",
    "card": f"CASE WHEN length({DIGITS}) BETWEEN 13 AND 19 THEN {LUHN} ELSE false END",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
}
#: What an instance's characters must be like to join a kind.
SUITS = {
    "email": "v LIKE '%@%'",
    "ip": "v RLIKE r'^[0-9]+([.:][0-9]+)+$'",
    "card": "v RLIKE r'^[0-9 -]+$' AND length(regexp_replace(v, r'[^0-9]', '')) >= 12",
    "phone": "v RLIKE r'^[+0-9 ().-]+$' AND length(regexp_replace(v, r'[^0-9]', '')) BETWEEN 7 AND 15",
    SECRET: "v RLIKE r'^[A-Za-z0-9_+/=.-]{16,}$' AND v RLIKE '[0-9]' AND v RLIKE '[A-Za-z]'",
}


def _with_matches(rows: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Adds all matches in `t` as (s, v, before, after): placed by the lengths of what lies between them, with the text up to the next matches."""
    nothing = F.array().cast("array<string>")
    rows = rows.withColumn("hit", F.when(when, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(nothing))
    rows = rows.withColumn("gap", F.when(F.size("hit") > 0, F.split("t", pattern, -1)).otherwise(nothing))
    items = """transform(hit, (v, i) -> named_struct('g', length(gap[i]), 'v', v,
      'before', concat(IF(i > 0, hit[greatest(i - 1, 0)], ''), gap[i]), 'after', concat(gap[i + 1], coalesce(get(hit, i + 1), ''))))"""
    rows = rows.withColumn("items", F.expr(items))
    rows = rows.withColumn("blocks", F.expr(f"transform(sequence(0, greatest(size(items) - 1, 0) div {BLOCK}), b -> slice(items, b * {BLOCK} + 1, {BLOCK}))"))
    starts = """aggregate(transform(blocks, b -> aggregate(b, 0, (n, m) -> n + m.g + length(m.v))),
      named_struct('at', 0, 'out', cast(array() AS array<int>)), (acc, n) -> named_struct('at', acc.at + n, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"""
    rows = rows.withColumn("starts", F.expr(starts))
    placed = """flatten(transform(blocks, (b, i) -> aggregate(b,
      named_struct('at', starts[i], 'out', cast(array() AS array<struct<s: int, v: string, before: string, after: string>>)),
      (acc, m) -> named_struct('at', acc.at + m.g + length(m.v), 'out', array_append(acc.out,
        named_struct('s', acc.at + m.g, 'v', m.v, 'before', m.before, 'after', m.after))),
      acc -> acc.out)))"""
    return rows.withColumn(name, F.expr(placed)).drop("hit", "gap", "items", "blocks", "starts")


def occurrences(docs: DataFrame) -> DataFrame:
    """place, doc_id, the base spans of each kind, and seeds and candidates (kind, s, e, v) with the words around them (two, next)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")
    )
    digit, at = F.col("t").rlike("[0-9]"), F.contains("t", F.lit("@"))
    needs = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains("t", F.lit("+"))}
    for kind in KINDS:
        rows = _with_matches(rows, kind, PATTERNS[kind], needs[kind])
        rows = rows.withColumn(kind, F.expr(f"transform(filter({kind}, m -> {VALID[kind]}), m -> named_struct('s', m.s, 'e', m.s + length(m.v)))"))
    rows = _with_matches(rows, "words", CANDIDATE, digit | at)
    trimmed = f"regexp_replace(regexp_replace(m.v, r'{HEAD}', ''), r'{TAIL}', '')"
    spaced = "trim(regexp_replace({}, r'\\s+', ' '))"
    words = f"""transform(words, m -> named_struct('s', m.s + length(m.v) - length(regexp_replace(m.v, r'{HEAD}', '')), 'v', {trimmed},
      'two', substring_index({spaced.format("m.before")}, ' ', -2), 'next', substring_index({spaced.format("m.after")}, ' ', 1)))"""
    rows = rows.withColumn("words", F.expr(f"filter({words}, m -> m.v <> '')"))
    kinds = " ".join(f"WHEN m.v RLIKE r'^(?:{PATTERNS[k]})$' AND {VALID[k]} THEN '{k}'" for k in KINDS)
    found = f"""transform(words, m -> named_struct('kind', CASE {kinds} WHEN m.v RLIKE r'{SECRET_SEED}' THEN '{SECRET}' END,
      's', m.s, 'e', m.s + length(m.v), 'v', m.v, 'two', m.two, 'next', m.next))"""
    return rows.select("place", "doc_id", *KINDS, F.expr(found).alias("found"))


def graph(found: DataFrame) -> DataFrame:
    """place, kind (null for candidates), s, e, v and the pattern, up to five rows for each occurrence."""
    each = found.select("place", F.inline("found"))
    for word in ("two", "next"):
        each = each.withColumn(word, F.expr(f"lower(regexp_replace({word}, '[0-9]+', '#'))"))
    one = "substring_index(two, ' ', -1)"
    patterns = f"""filter(array(concat('B ', {one}, ' _ ', next), IF(contains(two, ' '), concat('L ', two, ' _'), null),
      IF(two <> '', concat('P ', {one}, ' _'), null), IF(next <> '', concat('N _ ', next), null),
      IF(two <> '', concat('S ', regexp_replace(two, r'[\\p{{L}}_]+', 'a'), ' _'), null)), p -> p IS NOT NULL)"""
    return each.select("place", "kind", "s", "e", "v", F.explode(F.expr(patterns)).alias("pattern"))


def beliefs(occurring: DataFrame, at: str, support: int = SUPPORT, confident: float = CONFIDENT, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Counting patterns (pattern, kind, confidence) and believed candidates (v, kind, belief) once beliefs stand still."""
    edges = stored(occurring.groupBy("pattern", "v").agg(F.max("kind").alias("seed")), f"{at}/edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    sizes = stored(sizes, f"{at}/sizes")
    seeds = edges.where("seed IS NOT NULL").select("pattern", "v", F.col("seed").alias("kind"), F.lit(1.0).alias("belief"))
    suits = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.expr(SUITS[k]) for k in SUITS])
    believed, step = None, 0
    while True:
        known = seeds if believed is None else seeds.unionByName(edges.where("seed IS NULL").join(believed, "v").select("pattern", "v", "kind", "belief"))
        backed = known.groupBy("pattern", "kind").agg(F.sum("belief").alias("backing")).where(F.col("backing") >= support)
        share = F.col("backing") / (F.col("n") + 2)
        patterns = backed.join(sizes, "pattern").select("pattern", "kind", share.alias("confidence")).where(F.col("confidence") >= confident)
        patterns = stored(patterns, f"{at}/patterns{step}")
        held = edges.where("seed IS NULL").join(patterns, "pattern").where(suits)
        belief = 1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))
        now = stored(held.groupBy("v", "kind").agg(belief.alias("belief")), f"{at}/believed{step}")
        before = now.limit(0) if believed is None else believed
        change = now.join(before.withColumnRenamed("belief", "was"), ["v", "kind"], "left").agg(F.max(F.col("belief") - F.coalesce("was", F.lit(0.0))))
        believed, step = now, step + 1
        if (change.first()[0] or 0.0) <= tolerance:
            return patterns, believed


def _listed(columns: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind, then by start."""

    def named(kind: str, spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", F.lit(kind), m["s"], m["e"]))

    return F.concat_ws(",", F.concat(*[named(k, c) for k, c in columns.items()]))


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of every row, with n_found, the number of spans that the method adds."""
    spark = docs.sparkSession
    at = folder(spark, "pii")
    found = stored(occurrences(docs), f"{at}/found")
    occurring = stored(graph(found), f"{at}/graph")
    patterns, believed = beliefs(occurring, at, **how)
    sure = believed.where(F.col("belief") >= BELIEVED).groupBy("v").agg(F.min_by("kind", F.struct(-F.col("belief"), "kind")).alias("kind"))
    counted = patterns.select("pattern", "kind")
    candidates = occurring.where("kind IS NULL").drop("kind").join(counted, "pattern").join(sure, ["v", "kind"])
    secrets = occurring.where(F.col("kind") == SECRET).join(counted, ["pattern", "kind"], "left_semi")
    new = candidates.select("place", "kind", "s", "e").unionByName(secrets.select("place", "kind", "s", "e"))
    # the words of one text, so no group is larger than a text
    every = [*KINDS, SECRET]
    per_text = new.groupBy("place").agg(*[F.collect_set(F.when(F.col("kind") == k, F.struct("s", "e"))).alias(f"new_{k}") for k in every])
    both = found.drop("found").join(per_text, "place", "left")
    base, nothing = f"concat({', '.join(KINDS)})", F.expr("cast(array() AS array<struct<s: int, e: int>>)")
    for k in every:
        free = F.expr(f"filter(new_{k}, n -> NOT exists({base}, b -> b.s < n.e AND n.s < b.e))")
        both = both.withColumn(f"new_{k}", F.coalesce(free, nothing))
    spans = {k: F.concat(F.col(k), F.col(f"new_{k}")) for k in KINDS} | {SECRET: F.col(f"new_{SECRET}")}
    listed = _listed({k: F.col(k) for k in KINDS})
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    added = reduce(lambda a, b: a + b, [F.size(f"new_{k}") for k in every]).cast("long")
    return both.select("doc_id", *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"), added.alias("n_found"))
