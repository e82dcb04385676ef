"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that introduce a quotation are dropped at every level, and each message is
split into runs of lines of one quote level.  Level 0 is what its writer wrote;
every other run is a quoted passage.  A passage is normalised (white space
collapsed, trimmed, lower-cased), hashed, and joined to earlier messages of the
same conversation that are the same as a whole, hold it as a line or as lines one
after the other (blank ones aside), or, from PART_WORDS words on, hold its words
one after the other, however the lines are broken.  Words are compared by the
hashes of two windows of 2**n words, which begin and end the passage, so a
message has a hash for each word and n, not for each length that is quoted.  Of
sources with the same hash the latest before the quotation counts; it comes from
ordered windows of bounded ranges of turns, so that neither quotations nor
sources are paired.  The message replies to the
latest source of its shallowest linked passages.

Replies make trees.  Each message is led to the root of its tree by pointers
that jump twice as far in every round.  Conversations are then put into reply
order: tree by tree, and each reply behind the message it replies to.  Quotes
and the attribution lines that introduce them are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .native import let
from .shared import BROADCAST_ROWS, Scratch, broadcast_if_small

#: Fewest words of a passage that is looked for inside lines and across them.
PART_WORDS = 5
#: Turns of a conversation that are ordered together; a longer one is split.
TURNS = 1000
_QUOTE = "^[ \\t]*+((?:>[ \\t]*+)*+)"
#: Fixed form of the line that introduces a quotation.
_ATTRIBUTION = "^(On|Le|Am|El) .*(wrote|écrit|schrieb|escribió) ?:$"


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " ")))


def _lines(text: Column) -> Column:
    """Its lines, normalised, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n", -1), normalise), lambda x: F.length(x) > 0)


def _md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _parts(whole: Column, lines: Column, sizes: Column) -> Column:
    """Array of (m, part): for each of ``sizes`` the hashes of all m lines in a row; 0 stands for the whole text."""

    def of(m: Column) -> Column:
        window = lambda i: F.when(m == 1, F.get(lines, i)).otherwise(_md5(F.array_join(F.slice(lines, i + 1, m), "")))
        some = F.when(F.size(lines) >= m, F.transform(F.sequence(F.lit(0), F.size(lines) - m), lambda i: F.struct(m.alias("m"), window(i).alias("part"))))
        none = F.array().cast("array<struct<m: int, part: string>>")
        return F.coalesce(F.when(m == 0, F.array(F.struct(m.alias("m"), whole.alias("part")))).otherwise(some), none)

    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def _windows(words: Column, levels: Column) -> Column:
    """Array of (level, at, hash): for each level n up to ``levels`` the hash of the 2**n words from each word on."""
    ones = F.transform(words, lambda w: F.xxhash64(w))

    def double(acc: Column, n: Column) -> Column:
        last, half = F.element_at(acc, -1), F.pow(F.lit(2), n - 1).cast("int")
        return F.array_append(acc, F.zip_with(F.slice(last, F.lit(1), F.greatest(F.size(last) - half, F.lit(0))), F.slice(last, half + 1, F.greatest(F.size(last) - half, F.lit(0))), lambda a, b: F.xxhash64(a, b)))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    every = F.aggregate(steps, F.array(ones), double)
    return F.flatten(F.transform(every, lambda hashes, n: F.transform(hashes, lambda h, at: F.struct(n.alias("level"), at.alias("at"), h.alias("hash")))))


def _part_sources(known: DataFrame, quoted: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, hash, turn): turns whose words hold those of a quoted passage one after the other.

    ``quoted`` has conv_id, hash and the passage's words.
    """
    level = F.floor(F.log2(F.size("words"))).cast("int")
    asked = quoted.where(F.size("words") >= PART_WORDS).dropDuplicates(["conv_id", "hash"]).withColumn("level", level)
    # the window at a place p of the passage, p = 0 and the last one of the same size
    end = F.size("words") - F.pow(F.lit(2), F.col("level")).cast("int")
    asked = asked.withColumns({"end": end, "w": F.filter(_windows(F.col("words"), F.col("level")), lambda x: (x["level"] == F.col("level")) & ((x["at"] == 0) | (x["at"] == F.col("end"))))})
    asked = asked.select("conv_id", "hash", "level", "end", F.element_at("w", 1)["hash"].alias("first"), F.element_at("w", -1)["hash"].alias("last"))
    asked = scratch.write(asked, "asked")
    deepest = broadcast_if_small(scratch.write(asked.groupBy("conv_id").agg(F.max("level").alias("levels")), "deepest"))
    wanted = asked.select("conv_id", "level", F.explode(F.array("first", "last")).alias("w")).distinct()
    wanted = broadcast_if_small(scratch.write(wanted, "wanted-windows"))
    held = known.where("length(content) > 0").join(deepest, "conv_id").select("conv_id", "turn", F.explode(_windows(F.split(normalise(F.col("content")), " "), F.col("levels"))).alias("x"))
    held = held.select("conv_id", "turn", "x.level", "x.at", F.col("x.hash").alias("w"))
    held = scratch.write(held.join(wanted, ["conv_id", "level", "w"], "left_semi").distinct(), "held-windows")
    begins = held.join(asked.withColumnRenamed("first", "w"), ["conv_id", "level", "w"]).select("conv_id", "turn", "hash", "level", (F.col("at") + F.col("end")).alias("at"), F.col("last").alias("w"))
    return begins.join(held, ["conv_id", "turn", "level", "at", "w"], "left_semi").select("conv_id", "hash", "turn").distinct()


def _latest(quoters: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Quoters (keys, turn, ...) with the latest turn of a source (keys, turn) before theirs, as ``source``.

    Ordered within ranges of TURNS turns; of earlier ranges only the last source is looked at.
    """
    others = [c for c in quoters.columns if c not in (*keys, "turn")]
    rows = quoters.withColumns({"source": F.lit(None).cast("long"), "asks": F.lit(True)}).unionByName(sources.select(*keys, "turn", F.col("turn").alias("source"), F.lit(False).alias("asks")), allowMissingColumns=True)
    rows = rows.withColumn("range", F.floor(F.col("turn") / TURNS))
    own = Window.partitionBy(*keys, "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys, "range").agg(F.max("source").alias("last")).withColumn("earlier", F.max("last").over(before)).drop("last")
    rows = rows.withColumn("near", F.max("source").over(own)).where("asks").join(ranges.where("earlier is not null"), [*keys, "range"], "left")
    return rows.withColumn("source", F.coalesce("near", "earlier")).where("source is not null").select(*keys, "turn", *others, "source")


def _before(rows: DataFrame, keys: list[str], order: str, weight: str, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the same keys that are smaller in ``order``, which is unique there."""
    rows = rows.withColumn("range", F.floor(F.col(order) / TURNS))
    ahead = lambda by, *more: Window.partitionBy(*keys, *more).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys, "range").agg(F.sum(weight).alias("all"))
    ranges = ranges.withColumn("earlier", F.coalesce(F.sum("all").over(ahead("range")), F.lit(0))).drop("all")
    rows = rows.withColumn("own", F.coalesce(F.sum(weight).over(ahead(order, "range")), F.lit(0))).join(ranges, [*keys, "range"])
    return rows.withColumn(name, F.col("earlier") + F.col("own")).drop("range", "earlier", "own")


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, thread): the root of each turn that replies, from links (conv_id, turn, up) to earlier turns."""
    links, step = scratch.write(links, "up-0"), 0
    while True:
        further = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"))
        step += 1
        moved = scratch.write(links.join(further, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), f"up-{step}")
        scratch.drop(f"up-{step - 1}")
        if moved.where("moved").isEmpty():
            return moved.select("conv_id", "turn", F.col("up").alias("thread"))
        links = moved.drop("moved")


def _runs(text: Column) -> Column:
    """Array of (level, body): maximal runs of lines with the same quote level, lines that introduce a quotation aside."""
    lines = F.transform(
        F.split(F.regexp_replace(text, "\\r", ""), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), "[^>]", "")).alias("level"), F.when(F.regexp_extract(x, _QUOTE, 1) != "", F.regexp_replace(x, _QUOTE, "")).otherwise(x).alias("body")),
    )

    def cut(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.when(i == 0, True).otherwise(F.get(rows, i)["level"] != F.get(rows, i - 1)["level"]))

        def build(s: Column) -> Column:
            return F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(rows, at)["level"].alias("level"),
                    F.array_join(F.transform(F.slice(rows, at + 1, F.coalesce(F.get(s, k + 1), F.size(rows)) - at), lambda r: r["body"]), "\n").alias("body"),
                ),
            )

        return let(starts, build)

    kept = F.filter(lines, lambda x: ~F.trim(x["body"]).rlike(_ATTRIBUTION))
    none = F.array().cast("array<struct<level: int, body: string>>")
    return let(kept, lambda rows: F.when(F.size(rows) > 0, cut(rows)).otherwise(none))


def _own(runs: Column) -> Column:
    """What the writer wrote, without attribution lines."""
    text = F.array_join(F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["body"]), "\n")
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.trim(x).rlike(_ATTRIBUTION))
    return F.regexp_replace(F.array_join(kept, "\n"), "^[ \\t\\n]+|[ \\t\\n]+$", "")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply links and quote-free text of every message.

    Returns one row for each input row: conv_id, turn, role, content (own words,
    trimmed), n_quotes (quoted passages with a word), n_linked (those found in an
    earlier turn), max_level, reply_to (turn, null if nothing is linked), thread
    (turn at the root of its reply tree) and position (place in the reply order
    of its conversation, from 0: by thread, then by turn).  Rows that repeat a
    turn share thread and position; of their replies the one to the latest turn
    decides.  Null and empty texts have empty content and no quotes.  Messages
    with a null conversation or turn are kept, but neither link nor are linked
    to, and have a null thread and position.  Only the four named columns are
    read; an empty table gives none.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    base = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    quoting = base.text.rlike("(?m)^[ \\t]*>")
    plain = F.array(F.struct(F.lit(0).alias("level"), F.regexp_replace("text", "\\r", "").alias("body")))
    split = let(
        F.when(quoting, _runs(F.col("text"))).otherwise(plain),
        lambda runs: F.struct(
            _own(runs).alias("content"), F.coalesce(F.array_max(F.transform(runs, lambda r: r["level"])), F.lit(0)).cast("long").alias("max_level"),
            F.transform(F.filter(runs, lambda r: r["level"] > 0), lambda r: F.struct(r["level"].alias("level"), normalise(r["body"]).alias("norm"), F.transform(_lines(r["body"]), _md5).alias("lines"))).alias("quotes"),
        ),
    )
    runs = base.select("conv_id", "turn", "role", F.xxhash64("conv_id", "turn", "role", "text").alias("key"), split.alias("s")).select("conv_id", "turn", "role", "key", "s.*")
    runs = scratch.write(runs, "runs")
    known = runs.where("conv_id is not null and turn is not null")

    quoted = known.select("conv_id", "turn", "key", F.explode("quotes").alias("q")).where("length(q.norm) > 0")
    quoted = quoted.select("conv_id", "turn", "key", "q.level", _md5(F.col("q.norm")).alias("hash"), F.split("q.norm", " ").alias("words"), "q.lines").distinct()
    quoted = scratch.write(quoted, "quoted")
    turns = known.select("conv_id", "turn").distinct().withColumn("one", F.lit(1))
    if quoted.isEmpty():  # every message begins a tree of its own
        places = _before(turns, ["conv_id"], "turn", "one", "position").select("conv_id", "turn", F.col("turn").alias("thread"), F.col("position").cast("long").alias("position"))
        out = runs.join(places, ["conv_id", "turn"], "left")
        return out.select("conv_id", "turn", "role", "content", F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), "max_level", F.lit(None).cast("long").alias("reply_to"), "thread", "position")

    counts = quoted.groupBy("key").agg(F.count_distinct("level", "hash").alias("n_quotes"))
    kind = lambda m, part: F.struct(m.cast("int").alias("m"), part.alias("part"))
    # lines one after the other have PART_WORDS - 1 words at most, and so as many lines; longer passages are looked for by their words
    few_words = F.size("words") < PART_WORDS
    ways = F.array(kind(F.lit(0), F.col("hash")), kind(F.lit(1), F.col("hash")), kind(F.size("lines"), F.when(few_words & (F.size("lines") > 1), _md5(F.array_join("lines", "")))))
    wanted = quoted.select("conv_id", "turn", "key", "level", "hash", F.explode(F.filter(ways, lambda w: w["part"].isNotNull())).alias("w")).select("conv_id", "turn", "key", "level", "hash", "w.*")
    wanted = scratch.write(wanted, "wanted")

    # only conversations that quote need an index, and only of as many lines in a row as they quote
    sizes = scratch.write(wanted.select("conv_id", "m").distinct(), "sizes")
    few = sizes.count() <= BROADCAST_ROWS
    sizes = sizes.groupBy("conv_id").agg(F.collect_set("m").alias("sizes"))
    parts = known.where("length(content) > 0").join(F.broadcast(sizes) if few else sizes, "conv_id")
    parts = parts.select("conv_id", "turn", F.explode(let(F.transform(_lines(F.col("content")), _md5), lambda lines: _parts(_md5(normalise(F.col("content"))), lines, F.col("sizes")))).alias("p"))
    keys = ["conv_id", "m", "part"]
    sources = parts.select("conv_id", "turn", "p.*").join(wanted.select(*keys).distinct(), keys, "left_semi").distinct()
    linked = _latest(wanted, sources, keys).select("key", "level", "hash", "source")
    by_words = quoted.where(~few_words).select("conv_id", "turn", "key", "level", "hash")
    linked = linked.unionByName(_latest(by_words, _part_sources(known, quoted, scratch), ["conv_id", "hash"]).select("key", "level", "hash", "source"))
    linked = scratch.write(linked.groupBy("key", "level", "hash").agg(F.max("source").alias("source")), "linked")
    first = linked.groupBy("key").agg(F.count("*").alias("n_linked"), F.max(F.struct((-F.col("level")).alias("level"), "source")).alias("best")).select("key", "n_linked", F.col("best.source").alias("reply_to"))

    # trees of replies, then places: threads before one's own, and turns before it in its thread
    replies = known.join(first, "key").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up"))
    roots = _roots(replies.where("up is not null"), scratch)
    turns = scratch.write(turns.join(roots, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn")), "turns")
    threads = _before(turns.groupBy("conv_id", "thread").agg(F.sum("one").alias("n")), ["conv_id"], "thread", "n", "threads_before")
    places = _before(turns, ["conv_id", "thread"], "turn", "one", "turns_before").join(threads.drop("n"), ["conv_id", "thread"])
    places = places.select("conv_id", "turn", "thread", (F.col("threads_before") + F.col("turns_before")).cast("long").alias("position"))

    out = runs.drop("quotes").join(counts, "key", "left").join(first, "key", "left").join(places, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "content", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "max_level", "reply_to", "thread", "position"
    )


def render(linked: DataFrame) -> DataFrame:
    """Chat text of each message that has content, in a fixed markup; order by conv_id and position."""
    return linked.where("length(content) > 0").select("conv_id", "position", "reply_to", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "content").alias("chat"))
