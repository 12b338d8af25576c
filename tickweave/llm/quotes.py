"""Chat formatting: quotation linking and reply order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickweave.llm.common import materialize, text_of

#: A line that announces a quote, in four languages.
ATTRIBUTION = r"(?i)^\s*(on\s.*\swrote|am\s.*\sschrieb.*|le\s.*\sa\sécrit|el\s.*\sescribió)\s*:\s*$"
#: Words from which a quote may be any part of its original, 4 as windows() hashes them; a shorter one is a whole line, sentence or paragraph.
WINDOW = 4
#: Where a sentence ends.
SENTENCE = r"(?<=[.!?…])[\s\x{A0}]+|(?<=[。！？])"
_QUOTE = r"^[\x20\t]*>"
_MARKS = r"^((?:[\x20\t]*>)+)"


def _lines(text: Column) -> Column:
    """Lines as structs: quote level, and what is behind the quote marks."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 1)
        return F.struct(
            F.length(F.regexp_replace(marks, "[^>]", "")).cast("int").alias("level"),
            F.substring(line, F.length(marks) + 1, F.length(line)).alias("body"),
        )

    return F.transform(F.split(text, r"\r\n|\r|\n"), one)


def words_of(body: Column) -> Column:
    """Words as compared: in lower case, free of white space and line breaks; in scripts without spaces each character is one."""
    spaced = F.regexp_replace(F.lower(body), r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", " $1 ")
    return F.filter(F.split(spaced, r"[\s\x{A0}]+"), lambda w: w != "")


def windows(words: Column) -> Column:
    """A hash of each WINDOW words in a row."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)
    pairs = F.zip_with(one, F.slice(one, F.lit(2), n), lambda x, y: F.xxhash64(x, y))
    fours = F.zip_with(pairs, F.slice(pairs, F.lit(3), n), lambda x, y: F.xxhash64(x, y))
    return F.slice(fours, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))


def _hash(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and without lines that announce a quote right before one."""
    lines = F.split(text, r"\r\n|\r|\n")
    quoted = lambda line: line.rlike(_QUOTE)

    def stays(line: Column, i: Column) -> Column:
        following = F.get(lines, i + 1)
        second = F.get(lines, i + 2)
        announces = line.rlike(ATTRIBUTION) & (F.coalesce(quoted(following), F.lit(False)) | ((F.trim(F.coalesce(following, F.lit("x"))) == "") & F.coalesce(quoted(second), F.lit(False))))
        return ~quoted(line) & ~announces

    return F.when(F.concat(F.lit("\n"), text).rlike(r"[\r\n][\x20\t]*>"), F.trim(F.array_join(F.filter(lines, stays), "\n"))).otherwise(text)


def _tree(linked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each answering place's root and depth by pointer doubling; or, where answers go in circles, the places on them."""
    places = linked.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.max(F.struct("parent_conv", "parent_turn")).alias("p"))
    tree = materialize(places.select("conv_id", "turn", F.col("p.parent_conv").alias("up_conv"), F.col("p.parent_turn").alias("up_turn"), F.lit(1).cast("long").alias("steps")), "quote-tree")
    reach, n = 1, tree.count()
    while True:
        above = tree.select(F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("far_conv"), F.col("up_turn").alias("far_turn"), F.col("steps").alias("more"))
        grown = tree.join(above, ["up_conv", "up_turn"], "left").select(
            "conv_id", "turn", F.coalesce("far_conv", "up_conv").alias("up_conv"), F.coalesce("far_turn", "up_turn").alias("up_turn"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("more").isNotNull().alias("grew"),
        )
        grown = materialize(grown, "quote-tree")
        tree, reach = grown.drop("grew"), 2 * reach
        if grown.where("grew").isEmpty():
            return tree.withColumn("steps", F.col("steps").cast("int")), None
        if reach > 2 * n:  # more steps than places: who still grows is led into a circle, and stands on it now
            return tree, grown.where("grew").select(F.col("up_conv").alias("conv_id"), F.col("up_turn").alias("turn")).distinct()


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages without their quotes, with links to what they quote, in reply order.

    A line's quote level is the number of ">" marks before its text. Adjacent quoted lines of one level are a passage. A passage is
    looked for in what messages say themselves (level 0), free of line breaks, so one that was wrapped anew, joined, or cut out of a
    longer line is found; a line of a passage that isn't found whole is looked for alone. From WINDOW words on, the places that begin
    with its first words are compared by a hash of all its words; a shorter one equals a whole line, sentence or paragraph. The original is the
    earliest message of the same conversation, before the quoting one, that says it; else the earliest in the conversation
    of least id that says it, a lower or a higher one. A message answers
    the original that holds most characters of its quotes of the lowest level that finds any (then the latest original).
    Where answers would go in a circle, those of its messages that answer a conversation of a higher id answer nothing.
    Root and depth follow the answers by pointer doubling. Ordered by (root_conv, root_turn, depth, conv_id, turn), every
    answer comes after what it answers.

    Originals are minima by hash, taken before the shuffle, so a passage that many messages share costs one row a task, and a
    quote joins one original at most.

    Nulls: a null text counts as empty; rows with a null conversation or turn keep their text without quotes, and link to nothing. Repeated
    rows get the same result each. A message without links is its own root of depth 0. An empty table gives no rows.

    Returns conv_id, turn, role, text, max_level, n_quoted, n_linked, parent_conv, parent_turn, root_conv, root_turn, depth.
    """
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), text_of(text_col).alias("raw")
    ).withColumn("me", F.xxhash64("raw"))
    has = F.concat(F.lit("\n"), F.col("raw")).rlike(r"[\r\n][\x20\t]*>")
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    me = ["conv_id", "turn", "me"]
    quotes = rows.where(named & has).dropDuplicates(me).select(*me, F.posexplode(_lines(F.col("raw"))).alias("pos", "line")).where("line.level > 0")
    quotes = quotes.select(*me, "pos", F.col("line.level").alias("level"), words_of(F.col("line.body")).alias("words")).where(F.size("words") > 0)
    order = Window.partitionBy(*me).orderBy("pos")
    follows = (F.col("pos") == F.lag("pos").over(order) + 1) & (F.col("level") == F.lag("level").over(order))
    quotes = quotes.withColumn("starts", F.when(follows, 0).otherwise(1))
    quotes = materialize(quotes.select("*", F.sum("starts").over(order).alias("passage")).drop("starts"), "quote-lines")
    passages = quotes.groupBy(*me, "level", "passage").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("lines")).where(F.size("lines") > 1)
    passages = passages.select(*me, "level", "passage", F.lit(None).cast("int").alias("pos"), F.flatten(F.col("lines.words")).alias("words"))
    units = quotes.select(*me, "level", "passage", "pos", "words").unionByName(passages)
    units = units.select(
        *me, "level", "passage", "pos", _hash(F.col("words")).alias("h"), F.size("words").alias("n"), F.length(F.array_join("words", " ")).alias("size"),
        F.get(windows(F.slice("words", 1, WINDOW)), F.lit(0)).alias("anchor"),
    )
    units = materialize(units, "quote-units")

    said = rows.where(named).select(*me, unquoted(F.col("raw")).alias("own"))
    lengths = materialize(units.where(F.col("n") >= WINDOW).groupBy("anchor").agg(F.collect_set("n").alias("lengths")), "quote-anchors")
    places = said.select(*me, F.posexplode(windows(words_of(F.col("own")))).alias("place", "anchor")).join(lengths, "anchor")
    places = materialize(places.groupBy(*me).agg(F.collect_set(F.struct("place", "lengths")).alias("places")), "quote-places")
    spans = said.join(places, me).select("conv_id", "turn", words_of(F.col("own")).alias("words"), "places").select("conv_id", "turn", "words", F.explode("places").alias("at")).select("conv_id", "turn", "words", F.col("at.place").alias("place"), F.explode("at.lengths").alias("n"))
    spans = spans.where(F.col("place") + F.col("n") <= F.size("words")).select("conv_id", "turn", _hash(F.slice("words", F.col("place") + 1, F.col("n"))).alias("h"))
    lines, sentences, paragraphs = F.split("own", r"\r\n|\r|\n"), F.split("own", SENTENCE), F.split("own", r"(?:\r\n|\r|\n)[\x20\t]*(?:\r\n|\r|\n)")
    short = said.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(lines, sentences, paragraphs))).alias("part"))
    # a part of fewer than WINDOW words; in scripts without spaces these are no more than so many characters
    short = short.select("conv_id", "turn", words_of(F.col("part")).alias("words")).where(F.size("words").between(1, WINDOW - 1)).select("conv_id", "turn", _hash(F.col("words")).alias("h"))
    wanted = units.select("h").distinct()
    heard = spans.unionByName(short).join(wanted, "h", "left_semi").groupBy("h", "conv_id").agg(F.min("turn").alias("turn"))
    heard = materialize(heard, "quote-originals")

    here = heard.select("h", "conv_id", F.col("turn").alias("at"))
    first = heard.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    second = heard.join(first, "h").where(F.col("conv_id") > F.col("first.conv_id")).groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    found = units.join(here, ["h", "conv_id"], "left").join(first, "h", "left").join(second, "h", "left")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    to = F.when(F.col("at") < F.col("turn"), F.struct("conv_id", F.col("at").alias("turn"))).otherwise(other)
    found = found.select(*me, "level", "passage", "pos", "size", F.struct(to["conv_id"].alias("conv"), to["turn"].alias("turn")).alias("to"))
    found = found.withColumn("to", F.when(F.col("to.conv").isNotNull(), F.col("to")))
    whole = F.max(F.when(F.col("pos").isNull(), F.col("to"))).over(Window.partitionBy(*me, "passage"))
    found = found.withColumn("to", F.coalesce(whole, "to")).where("pos is not null")
    by_target = found.groupBy(*me, "level", "to").agg(F.sum("size").alias("chars"), F.count("*").alias("lines"))
    best = by_target.groupBy("conv_id", "turn", "me").agg(
        F.max("level").alias("max_level"),
        F.sum("lines").alias("n_quoted"),
        F.sum(F.when(F.col("to").isNotNull(), F.col("lines")).otherwise(0)).alias("n_linked"),
        F.max(F.when(F.col("to").isNotNull(), F.struct((-F.col("level")).alias("level"), "chars", F.col("to.conv").alias("conv"), F.col("to.turn").alias("at")))).alias("best"),
    )
    linked = materialize(best.select("conv_id", "turn", "me", "max_level", "n_quoted", "n_linked", F.col("best.conv").alias("parent_conv"), F.col("best.at").alias("parent_turn")), "quote-links")

    while True:
        tree, circles = _tree(linked)
        if circles is None:
            break
        # a circle has an answer to a higher place at least
        at_circle = circles.select("conv_id", "turn", F.lit(True).alias("circle"))
        up = F.coalesce("circle", F.lit(False)) & (F.struct("parent_conv", "parent_turn") > F.struct("conv_id", "turn"))
        linked = linked.join(at_circle, ["conv_id", "turn"], "left").withColumn("up", F.coalesce(up, F.lit(False))).drop("circle")
        linked = materialize(linked.withColumns({c: F.when(~F.col("up"), F.col(c)) for c in ("parent_conv", "parent_turn")}).drop("up"), "quote-links")
    out = rows.join(linked, ["conv_id", "turn", "me"], "left").join(tree, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", unquoted(F.col("raw")).alias("text"),
        F.coalesce("max_level", F.lit(0)).alias("max_level"), F.coalesce("n_quoted", F.lit(0).cast("long")).alias("n_quoted"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        "parent_conv", "parent_turn", F.coalesce("up_conv", "conv_id").alias("root_conv"), F.coalesce("up_turn", "turn").alias("root_turn"),
        F.coalesce("steps", F.lit(0)).alias("depth"),
    )
