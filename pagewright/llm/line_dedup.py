"""Duplicate lines by a segment-partition edit join, in DataFrame operations only.

Two lines within ``threshold`` edits share at least one of threshold + 1 segments, at
nearly the same place. Each distinct line is indexed by its segments and its length, and
looks up, for each length that it may be compared with, the few substrings that can
match there (multi-match-aware positions). What meets is verified by a banded
bit-parallel edit distance: the band's vertical differences are two integers that are
folded over the columns.

A segment that more than ``HOT`` lines share, as in a large group of near copies, would
make pairs by the square of their number. With a threshold of one, such a segment's
lines are split again instead: what is left of the line has one edit, so that two lines
agree in all but one of its parts. Parts are split until few lines are left, or one
place: lines that are equal but for one character are all linked with each other, and
are one class with a count; a line that is another without one character is found by
the whole of the other. So rows grow with the lines, not with their pairs.

Equal lines are one entry, whatever their number. Lines without a letter or digit aren't
looked at, and always stay; lines of fewer than ``min_chars`` characters only count as
equal or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_hot
from .graph import components

#: Edits, least length of lines that are compared for them, lines of a segment that meet in pairs, and parts of a split.
THRESHOLD, MIN_CHARS, HOT, FAN = 1, 20, 16, 8
#: Bits of a filter for each entry, in buckets of BUCKET bits, and its most buckets (64 MB in all): then more rows pass, and none is lost.
FILTER_BITS, BUCKET, MOST_BUCKETS = 8, 1 << 15, 1 << 14
#: A line's name.
LINE = ("h1", "h2")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (id, row, line number from 0, body, two hashes that stand for it) of all lines that are looked at.

    ``row`` is a hash of the text: with the id, it tells rows that repeat an id from each other.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("line", "body"))
    hashes = {"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit("again"), "body")}
    return rows.where(F.col("body").rlike(r"[\p{L}\p{N}]")).withColumns(hashes)


def segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line."""
    at = lambda k: F.lit(0) if k == 0 else length if k == parts else F.call_function("div", length * k, F.lit(parts)).cast("int")
    return at(i), at(i + 1) - at(i)


def keyed(body: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.call_function("substring", body, start + 1, size))


def lookups(threshold: int) -> list[tuple[int, int, int]]:
    """(less, i, by): segment i of lines that are shorter by ``less`` is looked up at ``by`` from its place."""
    out = []
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            low, high = max(-i, less - (threshold - i)), min(i, less + (threshold - i))
            out += [(less, i, by) for by in range(low, high + 1)]
    return out


def lookup_key(body: Column, length: Column, threshold: int, less: int, i: int, by: int) -> Column:
    """Key of a lookup; null where the substring would leave the line. With no shift it is that of the line's own segment."""
    other = (length - less).cast("int")
    start, size = segment(other, i, threshold + 1)
    inside = (start + by >= 0) & (start + by + size <= length)
    return F.when(inside, keyed(body, other, i, start + by, size))


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings if it is at most ``threshold``, else more than it.

    Column j of the matrix has its band in rows j - t to j + t; bit k of a word stands for
    row j - t + k. The state is the band's positive and negative vertical differences and
    the distance in its last row, or in the last row of the matrix once the band leaves it.
    Both strings have at least ``threshold`` characters.
    """
    t, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    rows, columns = F.split(a, ""), F.split(b, "")
    m, n = F.length(a), F.length(b)

    def column(s: Column, j: Column) -> Column:
        now = F.get(columns, j - 1)
        match = F.lit(0)
        for k in range(width):
            match = match + F.when(F.get(rows, j - 1 - t + k) == now, 1 << k).otherwise(0)
        # Each step binds what the next one uses more than once.
        one = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), match.alias("x"))
        two = bind(one, lambda v: v.withField("d0", (((v["x"].bitwiseAND(v["vp"]) + v["vp"]).bitwiseXOR(v["vp"])).bitwiseOR(v["x"]).bitwiseOR(v["vn"])).bitwiseAND(full)))
        three = bind(
            two,
            lambda v: v.withField("hp", v["vn"].bitwiseOR(F.bitwise_not(v["d0"].bitwiseOR(v["vp"])).bitwiseAND(full))).withField("hn", v["d0"].bitwiseAND(v["vp"])),
        )
        bit = lambda word, k: F.call_function("shiftright", word, k).bitwiseAND(F.lit(1))

        def after(v: Column) -> Column:
            down = F.shiftright(v["d0"], 1)
            last = (m - j + t).cast("int")
            score = F.when(j <= m - t, F.lit(1) - bit(v["d0"], F.lit(2 * t))).otherwise(bit(v["hp"], last) - bit(v["hn"], last))
            return F.struct(
                v["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(v["hp"])).bitwiseAND(full)).alias("vp"),
                down.bitwiseAND(v["hp"]).alias("vn"),
                (v["d"] + score).alias("d"),
            )

        # The distance in the band's last row never falls, and at the end by 2 t at most.
        return F.when(s["d"] > 3 * t, s).otherwise(bind(three, after))

    start = F.struct(F.lit(full ^ ((1 << t) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(t).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), n), start, column, lambda s: s["d"])


def trimmed(x: Column, y: Column, threshold: int) -> Column:
    """struct(x, y) without equal starts and ends, which leaves the edit distance as it is.

    Blocks of half the length, a quarter and so on are taken off where they are equal, so
    that little more than the differences is left for the distance, and ``threshold``
    characters at least.
    """
    call = F.call_function

    def shorter(v: Column, k: int, start: bool) -> Column:
        h = F.shiftright(v["room"], k)
        side = "left" if start else "right"
        rest = (lambda c: call("substring", c, h + 1)) if start else (lambda c: call("left", c, F.length(c) - h))
        same = (h > 0) & (call(side, v["x"], h) == call(side, v["y"], h))
        return F.when(same, F.struct(rest(v["x"]).alias("x"), rest(v["y"]).alias("y"), v["room"].alias("room"))).otherwise(v)

    state = F.struct(x.alias("x"), y.alias("y"))
    for start in (True, False):
        state = bind(state, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), (F.least(F.length(v["x"]), F.length(v["y"])) - threshold).alias("room")))
        for k in range(1, 7):
            state = bind(state, lambda v, k=k, start=start: shorter(v, k, start))
    return state


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def met_pairs(slots: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of lines (h1, h2, g1, g2) that share a key: two that own it, or one that does and one that probes it."""
    own = slots.where("own").select(*key, *LINE)
    every = slots.select(*key, "own", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    later = (F.col("h1") < F.col("g1")) | ((F.col("h1") == F.col("g1")) & (F.col("h2") < F.col("g2")))
    return own.join(every, key).where(F.when(F.col("own"), later).otherwise((F.col("h1") != F.col("g1")) | (F.col("h2") != F.col("g2")))).select(*LINE, "g1", "g2")


def split_slots(slots: DataFrame, bodies: DataFrame) -> DataFrame:
    """The parts of each slot (h1, h2, own, swap, n, a, w), with keys (k1, k2) of all that is outside of them.

    A slot is a window of w characters from a on, in lines of n characters, that agree
    outside of it. For ``swap``, one of its characters differs; else a line of n + 1
    characters, which doesn't own the key, has one more in one of its w + 1 gaps.
    """
    places = F.col("w") + F.when(F.col("swap"), 0).otherwise(1)
    parts = F.least(F.lit(FAN), places)
    cut_at = lambda j: F.floor(places * j / F.col("parts")).cast("int")
    each = slots.withColumn("parts", parts).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    less = F.when(F.col("swap"), 0).otherwise(1)
    each = each.withColumns({"a": (F.col("a") + cut_at(F.col("j"))).cast("int"), "w": (cut_at(F.col("j") + 1) - cut_at(F.col("j")) - less).cast("int")})
    sub = lambda *x: F.call_function("substring", F.col("body"), *x)
    after = F.col("a") + F.col("w") + F.when(F.col("own"), 0).otherwise(1)
    outside = ["swap", "n", "a", "w", sub(F.lit(1), F.col("a")), sub((after + 1).cast("int"))]
    both = each.join(bodies, list(LINE)).withColumns({"k1": F.xxhash64(*outside), "k2": F.xxhash64(F.lit("again"), *outside)})
    return both.select(*LINE, "own", "swap", "n", "a", "w", "k1", "k2")


def refined(hot: DataFrame, bodies: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """What lines of hot segments (h1, h2, own, i) lead to: tables of pairs that meet, and classes (k1, k2, n, h1, h2).

    All lines of a class are equal but for one character.
    """
    n = F.length("body") - F.when(F.col("own"), 0).otherwise(1)
    first, second = segment(n, 0, 2)[1], segment(n, 1, 2)
    slots = hot.join(bodies, list(LINE)).select(
        *LINE, "own", n.cast("int").alias("n"), F.when(F.col("i") == 0, second[0]).otherwise(0).cast("int").alias("a"), F.when(F.col("i") == 0, second[1]).otherwise(first).cast("int").alias("w")
    )
    slots = slots.withColumn("swap", F.explode(F.when(F.col("own"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    pairs, classes = [], None
    while True:
        parts = cut(split_slots(slots, bodies))
        key = ["k1", "k2"]
        counts = parts.groupBy(key).agg(F.sum(F.col("own").cast("int")).alias("owners"), F.count(F.lit(1)).alias("all"))
        met = cut(parts.join(counts.where("owners >= 1 and all >= 2"), key))
        leaf = F.when(F.col("swap"), F.col("w") == 1).otherwise(F.col("w") == 0)
        few = F.col("all") <= HOT
        equal = met.where(F.col("swap") & leaf).select(*key, (F.col("owners") - 1).alias("others"), *LINE)
        classes = equal if classes is None else classes.union(equal)
        # Of a line without one character there is one: its links are as many as the lines that have one more.
        pairs.append(met_pairs(met.where(~F.col("swap") & leaf | ~leaf & few).select(*key, "own", *LINE), key))
        slots = met.where(~leaf & ~few).select(*LINE, "own", "n", "a", "w", "swap").distinct()
        if slots.isEmpty():
            return pairs, classes


def maybe_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` aren't in ``wanted``, and without a shuffle of them.

    Keys are hashed to the bits of a broadcast bitmap; what passes by chance is left to a join.
    """
    buckets = min(MOST_BUCKETS, wanted.count() * FILTER_BITS // BUCKET + 1)
    bit = F.pmod(F.xxhash64(F.lit("filter"), *keys), F.lit(buckets * BUCKET))
    bucket, place = fresh(rows, "bucket", "place")
    maps = wanted.select(F.shiftright(bit, 15).alias(bucket), bit.bitwiseAND(F.lit(BUCKET - 1)).alias("at")).groupBy(bucket).agg(F.bitmap_construct_agg("at").alias(place))
    at = bit.bitwiseAND(F.lit(BUCKET - 1)).cast("int")
    byte = F.conv(F.hex(F.call_function("substring", F.col(place), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    one = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    return rows.withColumn(bucket, F.shiftright(bit, 15)).join(F.broadcast(cut(maps)), bucket).where(one == 1).select(*rows.columns)


def linked_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Links between lines of ``distinct`` (h1, h2, pick, slots): pairs (h1, h2, g1, g2), each once, and classes (k1, k2, others, h1, h2).

    No pair is in both.
    """
    slots = distinct.where("slots is not null").select(*LINE, "pick", F.explode("slots").alias("s")).select(*LINE, "pick", "s.*").where("key is not null")
    counts = slots.groupBy("key").agg(F.sum(F.col("own").cast("int")).alias("owners"), F.count(F.lit(1)).alias("all"))
    met = cut(slots.join(counts.where("owners >= 1 and all >= 2").select("key", "all"), "key"))
    few = F.col("all") <= HOT if threshold == 1 else F.lit(True)
    needed = cut(met.groupBy(*LINE).agg(F.min("pick").alias("pick")))
    every = lines_of(docs, id_col, text_col).withColumn("pick", F.xxhash64("id", "row", "line")).select(*LINE, "pick", "body")
    bodies = cut(maybe_in(every, needed, [*LINE, "pick"]).join(needed, [*LINE, "pick"]).dropDuplicates(list(LINE)).select(*LINE, "body"))
    pairs, classes = [met_pairs(met.where(few), ["key"])], None
    hot = met.where(~few).select(*LINE, "own", "i").distinct()
    if threshold == 1 and not hot.isEmpty():
        more, classes = refined(hot, bodies)
        pairs += more
    every_pair = pairs[0]
    for p in pairs[1:]:
        every_pair = every_pair.union(p)
    turned = (F.col("h1") < F.col("g1")) | ((F.col("h1") == F.col("g1")) & (F.col("h2") < F.col("g2")))
    low, high = F.struct("h1", "h2"), F.struct(F.col("g1").alias("h1"), F.col("g2").alias("h2"))
    ordered = every_pair.select(F.when(turned, low).otherwise(high).alias("l"), F.when(turned, high).otherwise(low).alias("r"))
    once = ordered.select(F.col("l.h1").alias("h1"), F.col("l.h2").alias("h2"), F.col("r.h1").alias("g1"), F.col("r.h2").alias("g2")).distinct()
    other = bodies.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("body").alias("y"))
    both = once.join(bodies.withColumnRenamed("body", "x"), list(LINE)).join(other, ["g1", "g2"])
    near = bind(trimmed(F.col("x"), F.col("y"), threshold), lambda v: banded_distance(v["x"], v["y"], threshold) <= threshold)
    links = both.where(near).select(*LINE, "g1", "g2")
    if classes is None:
        zero = F.lit(0).cast("bigint")
        classes = links.where("false").select(zero.alias("k1"), zero.alias("k2"), zero.alias("others"), *LINE)
    return cut(links), cut(classes)


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Return (id, row, line, class_id, class_row, class_line, n_links) of each line that is in a class with another.

    A class is what links reach; it is named by its first place (smallest id, then text
    hash ``row``, then line). ``n_links`` counts the different lines that the line itself is
    linked with. Lines are parted by newlines and numbered from 0. Null and empty texts have
    no lines to look at. Rows that repeat an id are documents of their own, unless they
    repeat the text, too: those are one. Null ids are ids like others, and sort first.
    With a ``threshold`` over 1, lines of a hot segment are compared in pairs.
    """
    asked = lookups(threshold)
    keys = [F.when(F.col("length") >= min_chars, lookup_key(F.col("body"), F.col("length"), threshold, *a)).alias(f"s{k}") for k, a in enumerate(asked)]
    places = cut(lines_of(docs, id_col, text_col).withColumn("length", F.length("body")).select("id", "row", "line", *LINE, *keys))
    firsts = [F.first(f"s{k}").alias(f"s{k}") for k in range(len(asked))]
    counted = places.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("id", "row", "line")).alias("pick"), *firsts)
    slots = [F.struct(F.col(f"s{k}").alias("key"), F.lit(less == by == 0).alias("own"), F.lit(i).alias("i")) for k, (less, i, by) in enumerate(asked)]
    distinct = cut(counted.select(*LINE, "n", "pick", F.when(F.col("s0").isNotNull(), F.array(*slots)).alias("slots")))
    links, classes = linked_lines(docs, distinct, id_col, text_col, threshold)
    pair = lambda a, b: F.struct(F.col(a).alias("h1"), F.col(b).alias("h2"))
    heads = cut(classes.groupBy("k1", "k2").agg(F.min(pair("h1", "h2")).alias("v"), F.count(F.lit(1)).alias("n")))
    through = join_hot(classes, heads, ["k1", "k2"], "n").select(pair("h1", "h2").alias("u"), "v")
    reach = components(links.select(pair("h1", "h2").alias("u"), pair("g1", "g2").alias("v")).union(through), "u", "v")
    ends = links.select(*LINE, F.lit(1).alias("k")).union(links.select("g1", "g2", F.lit(1))).union(classes.select(*LINE, "others"))
    degree = ends.groupBy(*LINE).agg(F.sum("k").alias("n_links"))
    root = reach.select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "component")
    member = distinct.join(degree, list(LINE), "left").join(root, list(LINE), "left").where((F.col("n") > 1) | F.col("n_links").isNotNull())
    member = cut(member.select(*LINE, "n", F.coalesce("component", pair("h1", "h2")).alias("root"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    found = cut(join_hot(places.select("id", "row", "line", *LINE), member, list(LINE), "n"))
    firsts = cut(found.groupBy("root").agg(F.min(F.struct("id", "row", "line")).alias("first"), F.count(F.lit(1)).alias("n")))
    return join_hot(found, firsts, ["root"], "n").select(
        F.col("id").alias(id_col), "row", "line", F.col("first.id").alias("class_id"), F.col("first.row").alias("class_row"), F.col("first.line").alias("class_line"), "n_links"
    )


def is_repeat(id_col: str) -> Column:
    """Whether a row of ``duplicate_lines`` isn't its class's first place."""
    return ~(F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("class_row")) & (F.col("line") == F.col("class_line")))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every line removed from the text that repeats a class's first line.

    Texts without such lines, and null texts, stay as they are. A text may become empty.
    Rows that agree in id and text lose the same lines.
    """
    later = duplicate_lines(docs, id_col, text_col, **options).where(is_repeat(id_col))
    removed = later.groupBy(id_col, "row").agg(F.collect_set("line").alias("removed"))
    key, hashed, gone = fresh(docs, "id", "row", "removed")
    removed = removed.toDF(key, hashed, gone)
    lines = F.split(F.col(text_col), "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(hashed))
    joined = docs.join(removed, same, "left")
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)).drop(key, hashed, gone)
