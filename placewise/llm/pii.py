"""Personal data: exact patterns, and identifiers found by bootstrapping from the contexts of known ones.

All of it is column expressions and joins. Known entities are seeds. The words around a seed make lexical patterns, and
whatever looks like an identifier between the same words is an instance of the pattern. A pattern is as good as the share
of its distinct instances that are known or believed to be of a kind, an instance as good as its best pattern; both are
scored in turn on the graph of patterns and instances. Instances of high confidence are new identifiers. Secrets (kind
``key``: tokens, passwords) have no exact pattern; long hexadecimal values that are given a name are their seeds.

Work on a text grows with its length and its matches, not with pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm.text import spare
from placewise.session import written

# fixed values: kinds in order, and what an entity of each looks like. Repetitions take all they can and give nothing
# back, so that a long run costs no stack and is read once; an e-mail address begins where its run of characters does or
# where the last one ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds of spans that are only found by bootstrapping come after the others: secrets such as tokens and passwords.
ALL_KINDS = (*KINDS, "key")
KEY = len(KINDS)
_SPELLED = r"[A-Za-z0-9._%+-]++\x20?[(\[]\x20?(?i:at)\x20?[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]\x20?(?i:dot)\x20?[)\]])\x20?[A-Za-z0-9-]++)*+"
_GROUP = r"[0-9]++(?![A-Za-z_@+/]|[.-][A-Za-z])"
#: What may be an identifier: an address with its signs spelled out, up to six groups of digits, or a run of Latin letters and
#: digits with single marks inside. Other marks and other scripts end it, so no run of text is one candidate; none is too long.
CANDIDATE = rf"(?<![A-Za-z0-9._%+-]){_SPELLED}|(?<![A-Za-z0-9])(?:{_GROUP}(?:[\x20().-]{{1,2}}+{_GROUP}){{0,5}}+|[A-Za-z0-9]++(?:[._@+/-][A-Za-z0-9]++)*+)"
#: What a candidate must look like before it may be taken for a kind.
SHAPES = {
    "email": r"[@(\[]",
    "ip": r"^[0-9]+([.\x20-]{1,2}[0-9]+){3}$",
    "card": r"^([0-9][\x20.-]*){12,19}$",
    "phone": r"^[(]?([0-9][().\x20-]*){7,15}$",
    "key": r"^(?=.*[0-9])(?=.*[A-Za-z])[^\x20@]{12,}$",
}
#: A candidate like this, given as the value of something, is a seed of a key.
KEY_SEED = "^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: Texts without any of these hold nothing of interest.
MAYBE = r"[0-9@]|[(\[]\x20?(?i:at)\x20?[)\]]"
#: Characters of context that are looked at, distinct seeds that a pattern needs, rounds of scoring, and confidence.
REACH, SUPPORT, ROUNDS, CONFIDENCE = 48, 5, 4, 0.8
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
#: Items that :func:`scan` takes at once.
AT_ONCE = 128


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where it is used inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, first: Column, step, emit, kind: str) -> Column:
    """What ``emit(state, item)`` gives for each item in turn, as an array of type ``kind``; ``step`` makes the next state.

    Results are gathered in pieces, so arrays of any length are copied a bounded number of times.
    """
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / AT_ONCE).cast("int")), lambda c: F.slice(items, c * AT_ONCE + 1, AT_ONCE))

    def one(acc, x):
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x)).cast(kind)).alias("out"))

    def some(acc, piece):
        inner = F.aggregate(piece, F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out")), one)
        return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    zero = F.struct(first.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(pieces, zero, some, lambda acc: F.flatten(acc["out"]))


def cut(wide: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` of a text given in UTF-32, without reading what is before them."""
    mark = F.lit(bytearray(b"\x00\x00\xfe\xff"))  # taken off by the decoder, which would take one of the text's own
    return F.decode(F.concat(mark, F.substring(wide, start * 4 + 1, size * 4)), "UTF-32")


def matches(text: Column, pattern: str, kind: int) -> Column:
    """``start, kind, stop, value`` of the leftmost matches, in code points: texts between matches give the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, gaps, lambda v, g: F.struct(F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())

    def span(at, p):
        return F.struct((at + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + p["gap"] + p["size"]).alias("stop"), p["value"].alias("value"))

    return let(pairs, lambda p: scan(p, F.lit(0), lambda at, x: at + x["gap"] + x["size"], span, SPAN))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda span: _valid(kind, span["value"])


def _is_kind(k: int):
    return lambda span: span["kind"] == k


def base_spans(text: Column) -> Column:
    """All valid matches of the four patterns, by start, then kind. A null text has none."""
    parts = []
    for k, kind in enumerate(KINDS):
        mark = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        found = F.filter(matches(text, PATTERNS[kind], k), _is_valid(kind))
        parts.append(F.when(mark, found).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def _apart(spans: Column) -> Column:
    """Sorted spans without the candidates (negative kind) that overlap an entity: one pass each way over entities' ends."""
    is_base = lambda s: s["kind"] >= 0

    def ahead(stop, s):
        return F.when(is_base(s), F.greatest(stop, s["stop"])).otherwise(stop)

    def behind(start, s):
        return F.when(is_base(s), F.least(start, s["start"])).otherwise(start)

    free = lambda ok: lambda state, s: F.when(is_base(s) | ok(state, s), s)
    forth = scan(spans, F.lit(0), ahead, free(lambda stop, s: stop <= s["start"]), SPAN)
    kept = let(forth, lambda a: F.reverse(F.filter(a, lambda s: s.isNotNull())))
    back = let(kept, lambda a: scan(a, F.lit(2**31 - 1), behind, free(lambda start, s: start >= s["stop"]), SPAN))
    return F.filter(back, lambda s: s.isNotNull())


def _words(context: Column) -> Column:
    """Words, lower-cased and bare; runs of words with digits are one ``#``, whatever they are."""
    bare = F.trim(F.regexp_replace(F.lower(context), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(F.regexp_replace(bare, r"\p{L}*+\p{N}[\p{L}\p{N}]*+(?:\x20\p{L}*+\p{N}[\p{L}\p{N}]*+)*+", "#"), " "), lambda w: w != "")


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns of a place: the two words before, a word on either side, the word before alone, the name of a value."""
    ahead, behind = F.reverse(_words(before)), _words(after)
    two = F.when(F.size(ahead) >= 2, F.concat(F.lit("<"), F.get(ahead, F.lit(1)), F.lit(" "), F.get(ahead, F.lit(0))))
    around = F.when((F.size(ahead) > 0) & (F.size(behind) > 0), F.concat(F.lit("="), F.get(ahead, F.lit(0)), F.lit(" _ "), F.get(behind, F.lit(0))))
    one = F.when(F.size(ahead) > 0, F.concat(F.lit(">"), F.get(ahead, F.lit(0))))
    name = F.regexp_extract(F.lower(before), NAME, 1)
    return F.array_compact(F.array(two, around, one, F.when(name != "", F.concat(F.lit(":"), name))))


#: The name of a value that begins at the end of the text: ``phone=``, ``"token": "``, ``key = '``.
NAME = r"""([\p{L}][\p{L}\p{N}_-]*+)["']?\s{0,2}[=:]\s{0,2}["']?$"""


def occurrences(docs: DataFrame) -> DataFrame:
    """``h, start, stop, kind, instance, patterns``: entities (with their kind) and other candidates (kind null) of each text.

    A candidate that could be of no kind is left out of the places, not of the text around others. Contexts are cut
    where they stand, so the text itself is neither shuffled nor repeated. Copies of a text are looked at once.
    """
    digits = F.length(F.regexp_replace("s.value", "[^0-9]", ""))
    maybe = lambda s: s["value"].rlike(r"^(?:[^0-9]*+[0-9]){4}|[(\[]")
    other = F.filter(matches(F.col("t"), CANDIDATE, -1), maybe)
    held = docs.where(F.col("t").rlike(MAYBE)).select("h", "t", F.array_sort(F.concat("base", other)).alias("all"))
    places = let(F.encode("t", "UTF-32"), lambda wide: F.transform(_apart(F.col("all")), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"),
        cut(wide, F.greatest(s["start"] - REACH, F.lit(0)), F.least(s["start"], F.lit(REACH))).alias("before"),
        cut(wide, s["stop"], F.lit(REACH)).alias("after"))))
    once = held.select("h", places.alias("places")).where(F.size("places") > 0).groupBy("h").agg(F.first("places").alias("places"))
    made = once.select("h", F.explode("places").alias("s"))
    seed = (F.col("s.kind") < 0) & F.col("s.value").rlike(KEY_SEED) & (F.regexp_extract(F.lower("s.before"), NAME, 1) != "")
    kind = F.when(F.col("s.kind") >= 0, F.col("s.kind")).when(seed, F.lit(KEY))
    return made.where((F.col("s.kind") >= 0) | (digits >= 4) | F.col("s.value").rlike(SHAPES["email"])).select("h", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), kind.alias("kind"), F.lower("s.value").alias("instance"), _patterns(F.col("s.before"), F.col("s.after")).alias("patterns"))


def _may_be(instance: Column, kind: Column) -> Column:
    """Whether a candidate looks enough like a kind to be of it."""
    return F.coalesce(*[F.when(kind == i, instance.rlike(SHAPES[k])) for i, k in enumerate(ALL_KINDS)], F.lit(False))


def bootstrap(found: DataFrame) -> DataFrame:
    """``instance, kind``: unseen identifiers of high confidence among the occurrences, with the pattern that carries them.

    Edges join distinct patterns and instances, so copies of a text count once. A pattern's confidence in a kind is the
    belief in its instances over their number plus one; a candidate's is that of its best pattern, among those that have
    support and whose kind it looks like. Seeds of keys are judged like candidates; the four other kinds are exact.
    """
    edges = written(found.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"), F.count("kind").alias("seeds")).where(F.col("seeds") >= SUPPORT).select("pattern", "size")
    live = written(edges.alias("e").join(sizes.alias("z"), (F.xxhash64("e.pattern") == F.xxhash64("z.pattern")) & (F.col("e.pattern") == F.col("z.pattern"))).select("e.pattern", "e.instance", "e.kind", "z.size"), "live")
    seeds = live.where("kind IS NOT NULL").select("pattern", "instance", "size", "kind", F.lit(1.0).alias("belief"))
    candidates = live.where(f"kind IS NULL OR kind = {KEY}").select("pattern", "instance", "size", F.col("kind").alias("_seed"))
    beliefs = None
    for _ in range(ROUNDS):
        known = seeds if beliefs is None else seeds.unionByName(candidates.where("_seed IS NULL").drop("_seed").join(beliefs, "instance"))
        patterns = known.groupBy("pattern", "kind").agg((F.sum("belief") / (F.max("size") + 1)).alias("confidence"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
        patterns = patterns.withColumnRenamed("pattern", "_p")
        judged = candidates.join(patterns, (F.xxhash64("pattern") == F.xxhash64("_p")) & (F.col("pattern") == F.col("_p")) & _may_be(F.col("instance"), F.col("kind")))
        beliefs = written(judged.groupBy("instance", "kind").agg(F.round(F.max("confidence"), 9).alias("belief")), "beliefs")
    best = beliefs.groupBy("instance").agg(F.max(F.struct("belief", F.negative("kind").alias("k"))).alias("b"))
    return best.where(F.col("b.belief") >= CONFIDENCE).select("instance", F.negative("b.k").alias("kind"))


def new_spans(docs: DataFrame) -> DataFrame:
    """``h, added``: spans that the bootstrapping adds to each distinct text."""
    found = written(occurrences(docs), "occurrences")
    fresh = bootstrap(found).withColumnRenamed("instance", "_i").withColumnRenamed("kind", "_k")
    hits = found.where(f"kind IS NULL OR kind = {KEY}").join(fresh, (F.xxhash64("instance") == F.xxhash64("_i")) & (F.col("instance") == F.col("_i")))
    return hits.groupBy("h").agg(F.array_sort(F.collect_set(F.struct("start", F.col("_k").alias("kind"), "stop", F.col("instance").alias("value")))).alias("added"))


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row.

    Counts and the digest are those of the patterns; ``spans`` also holds what the bootstrapping adds, all as
    kind:start:end by start, then kind. A null or empty text has no spans, and the digest of an empty string. Rows with
    equal texts have equal results.
    """
    held = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    held = written(held.select("k", F.xxhash64("t").alias("h"), base_spans(F.col("t")).alias("base"), F.when(F.col("t").rlike(MAYBE), F.col("t")).alias("t")), "texts")
    added = new_spans(held).withColumnRenamed("h", "_h")
    out = held.drop("t").join(added, F.col("h") == F.col("_h"), "left")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    all_of = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return out.select(F.col("k").alias(key), *counts, F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.transform(all_of, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    Only texts with a digit, ``@`` or a spelled-out one are looked at further; all others, null and empty ones too, go on
    as they are. Equal texts are redacted alike; rows are never merged or dropped.
    """
    maybe = F.coalesce(F.col(text).rlike(MAYBE), F.lit(False))
    h, base, g, more, done = (spare(name, docs.columns) for name in ("_h", "_base", "_g", "_added", "_done"))
    touched = docs.where(maybe).withColumn(h, F.xxhash64(text)).withColumn(base, base_spans(F.col(text)))
    added = new_spans(touched.select(F.col(h).alias("h"), F.col(text).alias("t"), F.col(base).alias("base"))).select(F.col("h").alias(g), F.col("added").alias(more))
    joined = touched.join(added, F.col(h) == F.col(g), "left")
    spans = F.array_sort(F.concat(base, F.coalesce(more, F.array().cast(SPAN))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])

    def shown(wide):
        def piece(at, s):
            return F.when(s["start"] < at, F.lit("")).otherwise(F.concat(cut(wide, at, s["start"] - at), F.get(names, s["kind"])))

        parts = scan(F.col(done), F.lit(0), lambda at, s: F.greatest(at, s["stop"]), piece, "array<string>")
        last = F.coalesce(F.array_max(F.transform(done, lambda s: s["stop"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), cut(wide, last, F.greatest(F.length(text) - last, F.lit(0))))

    joined = joined.withColumn(done, spans)
    clean = let(F.encode(text, "UTF-32"), shown)
    return docs.where(~maybe).unionByName(joined.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns]))
