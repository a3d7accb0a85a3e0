"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Four base kinds are found by pattern and check: email, ip, card, phone. They are the seeds. The words around a
seed are lexical patterns of its kind; other tokens that look like identifiers (six or more digits or an @)
are candidate instances. Patterns and instances form a bipartite graph that Spark scores in rounds: a pattern's
confidence for a kind is the summed score of its instances over their number, an instance's score the noisy-or
of its patterns. A pattern needs ``min_support`` different seeds or found instances; candidates under a pattern of
``min_confidence`` become spans of its kind. A frequent word is an aggregate that is combined before the shuffle,
and only confident patterns are joined back.

A span's start is a sum over the matches before it, made by a window over narrow rows, so a text with many
matches is linear; so is the place of its word. The words around a match are taken in the scan, where the text is,
so nothing but matches and those words is shuffled. The patterns are the usual ones with possessive loops and fixed
starts: same matches, but neither recursion nor repeated scans on long runs.

Defined results: null texts are empty; texts without matches have no span; rows are told apart by id and text, and
repeated rows get the same spans; rows without id are searched as well; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import written

# The kinds in their order, and what each looks like.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
BLANKS = r"\s+"
CANDIDATE = r"(?<!\S)\S*[0-9@]\S*"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Longer words and instances are told apart by a hash.
WORD_CHARS = 100
# The score of a found instance stays below that of a seed.
HIGHEST_FOUND = 0.999999


def _luhn(digits: Column) -> Column:
    """True if the checksum of a short string of digits holds."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matched(text: Column, pattern: str, possible: Column, around: Column | None = None) -> Column:
    """The matches of a pattern with the length and the blanks of the text before each. No match has blanks at its ends.

    ``around`` has one more entry for each match.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [gaps.alias("gap"), found.alias("value")] + ([] if around is None else [around.alias("around")])
    entries = F.transform(
        F.arrays_zip(*parts),
        lambda x: F.struct(
            F.length(x["gap"]).alias("skip"),
            (F.size(F.split(x["gap"], BLANKS, -1)) - 1).alias("blanks"),
            x["value"].alias("value"),
            *([] if around is None else [x["around"].alias("around")]),
        ),
    )
    return F.when(possible, entries)


def _around(words: str, possible: Column) -> Column:
    """For each word that holds a digit or an @: the two words before and the word after it, whatever they hold."""
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).rlike("[0-9@]"))

    def word(i: Column) -> Column:
        return F.when(i >= 0, _short(F.lower(F.get(words, F.greatest(i, F.lit(0))))))

    around = F.transform(
        places,
        lambda i: F.struct(F.filter(F.array(word(i - 2), word(i - 1)), lambda w: w != "").alias("before"), F.coalesce(word(i + 1), F.lit("")).alias("after")),
    )
    return F.when(possible, around)


def _placed(rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, h, start, end, value, word, last) of the matches in a column made by ``_matched``, and ``around`` if it has that.

    ``word`` and ``last`` are the places of its first and last word in the text split at blanks.
    """
    each = rows.where(F.col(column).isNotNull()).select("doc_id", "h", F.posexplode(column).alias("pos", "m")).select("doc_id", "h", "pos", "m.*")
    order = Window.partitionBy("doc_id", "h").orderBy("pos")
    upto = F.sum(F.col("skip") + F.coalesce(F.length("value"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = F.coalesce(F.size(F.split("value", BLANKS, -1)) - 1, F.lit(0))
    each = each.withColumn("inside", F.when(F.col("value").isNull(), 0).otherwise(inside))
    last = F.sum(F.col("blanks") + F.col("inside")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = each.select("*", upto.alias("end"), last.alias("last"))
    return placed.where("value is not null").select(
        "doc_id",
        "h",
        (F.col("end") - F.length("value")).alias("start"),
        "end",
        "value",
        (F.col("last") - F.col("inside")).alias("word"),
        "last",
        *[c for c in ("around",) if c in placed.columns],
    )


def _short(text: Column) -> Column:
    return F.when(F.length(text) > WORD_CHARS, F.sha2(text, 256)).otherwise(text)


def _with_context(seeds: DataFrame, tokens: DataFrame) -> DataFrame:
    """seeds with ``before`` and ``after``. A seed begins and ends in words with a digit or an @, which are tokens."""
    near = tokens.select("doc_id", "h", "word", "around")
    same = "a.h = b.h and a.doc_id <=> b.doc_id"
    first = seeds.alias("a").join(near.alias("b"), F.expr(f"{same} and a.word = b.word")).select("a.*", "b.around.before")
    return first.alias("a").join(near.alias("b"), F.expr(f"{same} and a.last = b.word")).select("a.*", "b.around.after").drop("word", "last")


def _clear(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """The tokens that overlap no seed: a running maximum of the seeds' ends, and the next seed's start."""
    both = tokens.withColumn("seed", F.lit(False)).unionByName(seeds.select("doc_id", "h", "start", "end").withColumn("seed", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("seed"))
    reach = F.max(F.when(F.col("seed"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The least start of the seeds behind: seeds are in order, so the last one's row knows it.
    coming = F.min(F.when(F.col("seed"), F.col("start"))).over(Window.partitionBy("doc_id", "h").orderBy(F.desc("start"), "seed").rowsBetween(Window.unboundedPreceding, 0))
    marked = both.withColumns({"_reach": reach, "_coming": coming})
    free = ~F.col("seed") & (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.col("_coming").isNull() | (F.col("_coming") >= F.col("end")))
    return marked.where(free).drop("seed", "_reach", "_coming")


def row_hash() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the word before, the two before, and the words on both sides."""
    last = F.coalesce(F.get(before, F.size(before) - 1), F.lit(""))
    return F.array_distinct(
        F.filter(
            F.array(
                F.when(last != "", F.concat(F.lit("1 "), last)),
                F.when(F.size(before) > 1, F.concat(F.lit("2 "), F.array_join(before, " "))),
                F.when((last != "") & (after != ""), F.concat_ws(" ", F.lit("3"), last, after)),
            ),
            lambda p: p.isNotNull(),
        )
    )


def _expanded(seeds: DataFrame, others: DataFrame, min_support: int, min_confidence: float, rounds: int) -> DataFrame:
    """(doc_id, h, kind, start, end) of the candidates that confident patterns reach.

    ``seeds`` has a kind, ``others`` has none; both have the words around. Instances are values; occurrences link them to patterns.
    """
    both = seeds.unionByName(others.withColumn("kind", F.lit(None).cast("string"))).withColumn("value", _short(F.lower("value")))
    occurs = both.select(
        "doc_id", "h", "start", "end", "kind", F.col("value").alias("instance"), F.explode(_patterns(F.col("before"), F.col("after"))).alias("pattern")
    )
    occurs = written(occurs, "occurrences")
    graph = written(occurs.select("instance", "pattern").distinct(), "graph")
    degree = written(graph.groupBy("pattern").agg(F.count("*").alias("n")), "degree")
    seed_scores = occurs.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    scores, confident = written(seed_scores, "scores"), None
    for _ in range(rounds):
        held = graph.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= min_confidence).alias("support"))
        confidence = F.col("mass") / F.col("n")
        confident = held.where(F.col("support") >= min_support).join(degree, "pattern").withColumn("confidence", confidence)
        confident = written(confident.where(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence"), "confident")
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        reached = graph.join(confident, "pattern").groupBy("instance", "kind").agg(F.least(1 - miss, F.lit(HIGHEST_FOUND)).alias("score"))
        scores = written(scores.where("score = 1").unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")), "scores")
    best = occurs.where("kind is null").drop("kind").join(confident, "pattern")
    return best.groupBy("doc_id", "h", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))


def find_spans(docs: DataFrame, min_support: int = 4, min_confidence: float = 0.75, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h) of docs (doc_id, text), and their spans (doc_id, h, kind, start, end, base).

    ``h`` is a hash of id and text. Places are code points, the end exclusive. ``base`` is true for the four patterns.
    """
    text = F.coalesce("text", F.lit(""))
    digits, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    possible = {"email": at, "ip": digits, "card": digits, "phone": F.contains(text, F.lit("+"))}
    # The words are a column of their own, split once a row; only matches and the words around them are written.
    split = docs.select("doc_id", "text", F.when(digits | at, F.split(text, BLANKS, -1)).alias("words"))
    rows = written(
        split.select(
            "doc_id",
            row_hash().alias("h"),
            *[_matched(text, p, possible[k]).alias(k) for k, p in PATTERNS.items()],
            _matched(text, CANDIDATE, digits | at, _around("words", digits | at)).alias("token"),
        ),
        "matches",
    )
    some = rows.where(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in (*KINDS, "token"))))
    once = some.groupBy("doc_id", "h").agg(*[F.first(c).alias(c) for c in (*KINDS, "token")])
    seeds = reduce(
        DataFrame.unionByName,
        [_placed(once.select("doc_id", "h", k), k).where(_valid(k, F.col("value"))).withColumn("kind", F.lit(k)) for k in KINDS],
    )
    tokens = written(_placed(once.select("doc_id", "h", "token"), "token"), "tokens")
    seeds = written(_with_context(seeds, tokens), "seeds")
    # Candidates: without signs at their ends, and clear of every base span.
    core = F.regexp_extract("value", r"^([^A-Za-z0-9]*)(.*?)[^A-Za-z0-9]*$", 2)
    lead = F.length(F.regexp_extract("value", r"^([^A-Za-z0-9]*)", 1))
    tokens = tokens.withColumns({"core": core, "start": F.col("start") + lead})
    looks = (F.length(F.regexp_replace("core", "[^0-9]", "")) >= 6) | F.contains("core", F.lit("@"))
    tokens = tokens.where(looks).select(
        "doc_id", "h", "start", (F.col("start") + F.length("core")).alias("end"), F.col("core").alias("value"), "around.before", "around.after"
    )
    new = _expanded(seeds, written(_clear(tokens, seeds), "candidates"), min_support, min_confidence, rounds)
    spans = seeds.select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("base")).unionByName(
        new.select("doc_id", "h", "kind", "start", "end", F.lit(False).alias("base"))
    )
    return rows.select("doc_id", "h"), written(spans, "spans")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs (doc_id, text)."""
    rows, spans = find_spans(docs, **options)
    order = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    entry = F.struct(order.alias("k"), "start", F.concat_ws(":", "kind", "start", "end").alias("s"))

    def joined(condition: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(condition, entry))), lambda x: x["s"]), ",")

    per_row = spans.groupBy("doc_id", "h").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        joined(F.col("base")).alias("base_spans"),
        joined(F.lit(True)).alias("spans"),
    )
    a, b = rows.alias("a"), written(per_row, "per-row").alias("b")
    both = a.join(b, F.expr("a.h = b.h and a.doc_id <=> b.doc_id"), "left")
    return both.select(
        "a.doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with each span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    _, spans = find_spans(docs.select("doc_id", F.col(text).alias("text")), **options)
    order = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("new", F.when(F.coalesce(reach, F.lit(-1)) <= F.col("start"), 1).otherwise(0))
    run = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = fresh.withColumn("run", run).groupBy("doc_id", "h", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind")
    )
    cuts = merged.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_cuts"))
    cuts = written(cuts, "cuts").withColumnsRenamed({"doc_id": "_doc_id", "h": "_h"})
    # Every span holds a digit or an @, so most texts need not move to meet their cuts.
    may = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    rows = docs.where(may).withColumn("_hash", F.xxhash64("doc_id", F.coalesce(text, F.lit(""))))
    both = rows.join(cuts, (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    parts = F.transform(
        "_cuts",
        lambda c, i: F.concat(
            F.substr(F.col(text), F.when(i == 0, 0).otherwise(F.get("_cuts", i - 1)["end"]) + 1, c["start"] - F.when(i == 0, 0).otherwise(F.get("_cuts", i - 1)["end"])),
            F.lit("["), F.upper(c["kind"]), F.lit("]"),
        ),
    )
    rest = F.substr(F.col(text), F.element_at("_cuts", -1)["end"] + 1, F.length(text))
    clean = F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(F.concat(F.array_join(parts, ""), rest))
    return both.withColumn(text, clean).select(*docs.columns).unionByName(docs.where(~may))
