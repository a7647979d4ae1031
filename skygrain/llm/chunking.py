"""Oversized texts into pieces of at most LIMIT tokens at natural boundaries, with an overlap of OVERLAP tokens.

Tokenizing gives each oversized document its boundaries: token positions after paragraphs, lines and sentences, and hard
cuts where a stretch has none. Every boundary is joined to its farthest legal successor (the next piece starts OVERLAP tokens
before the cut), and the successor tables are squared: after k squarings a table jumps 2^k cuts, so all cuts of all
documents follow from log2(most pieces) joins on (document, boundary), however long a text is.

Positions are tokens of the whole text; hard cuts and starts prefer the start of a word and never divide a character.
A start may lie a little before the wanted overlap for that; the limit counts from the start, so it always holds.

Defined results: null and empty texts have no piece; a text of up to LIMIT tokens is one piece; equal rows have own pieces.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.llm.bpe import DEFAULT_VOCABULARY, Encoder, encoder, spread, vocabulary
from skygrain.sources.scratch import written

LIMIT, OVERLAP = 1024, 64
NODE = "pos:int,back:int,pos_char:int,back_char:int,kind:string"


def _kind(text: str, at: int) -> str | None:
    """What ends just before a word start."""
    before = text[at - 1]
    if before == "\n":
        return None if text[at] in "\r\n" else "paragraph" if at > 1 and text[at - 2 : at] in ("\n\n", "\r\n") and "\n" in text[max(0, at - 3) : at - 1] else "line"
    if before in "。！？｡":
        return "sentence"
    i = at - 1
    while i > 0 and text[i] in "\"'”’»)]":
        i -= 1
    return "sentence" if text[i] in ".!?…؟।" and text[at].isspace() else None


def boundaries(own: Encoder, text: str, limit: int, overlap: int) -> tuple[int, list[tuple]]:
    """(number of tokens, nodes); nodes only for a text over the limit."""
    total, starts, chars, kinds, at = 0, [], [], [], 0
    words = own.words.findall(text)
    for w in words:
        starts.append(total)
        chars.append(at)
        total += len(own.word(w))
        at += len(w)
    if total <= limit:
        return total, []

    inner: dict[int, tuple[list[int], list[int]]] = {}

    def inside(i: int) -> tuple[list[int], list[int]]:
        """Within word i: the token positions that end a character, and how many characters end there."""
        if i not in inner:
            encoded, size, n_chars, ends, counts = words[i].encode("utf-8", "replace"), 0, 0, [], []
            for n, token in enumerate(own.word(words[i]), 1):
                for byte in encoded[size : size + own.lengths[token]]:
                    n_chars += byte & 0xC0 != 0x80
                size += own.lengths[token]
                if size == len(encoded) or encoded[size] & 0xC0 != 0x80:
                    ends.append(starts[i] + n)
                    counts.append(chars[i] + n_chars)
            inner[i] = ends, counts
        return inner[i]

    def floor(pos: int, least: int) -> tuple[int, int]:
        """The last word start in (least, pos], else the last whole character there."""
        i = bisect_right(starts, pos) - 1
        if starts[i] > least:
            return starts[i], chars[i]
        # A word longer than the span: its own tokens, cut where characters end.
        ends, counts = inside(i)
        j = bisect_right(ends, pos) - 1
        return (ends[j], counts[j]) if j >= 0 and ends[j] > least else (starts[i], chars[i])

    def node(pos: int, char: int, kind: str) -> tuple:
        back, back_char = floor(max(0, pos - overlap), max(0, pos - 2 * overlap) - 1)
        return pos, back, char, back_char, kind

    nodes = [(overlap, 0, 0, 0, "start")]
    natural = [(starts[i], chars[i], k) for i in range(1, len(words)) if starts[i] > overlap and (k := _kind(text, chars[i]))]
    natural.append((total, at, "end"))
    for pos, char, kind in natural:
        while True:
            last = nodes[-1]
            if pos <= last[1] + limit:
                break
            # No natural boundary within reach: a hard cut as far as it may be.
            nodes.append(node(*floor(last[1] + limit, last[0]), "hard"))
            if nodes[-1][0] <= last[0]:
                raise ValueError("a token without a character's end within the limit")
        if pos > nodes[-1][0]:
            nodes.append(node(pos, char, kind))
    return total, nodes


def _nodes(data, limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(data.value)
        for pdf in batches:
            got = [boundaries(own, t, limit, overlap) if t else (0, []) for t in pdf["_text"]]
            names = [n.split(":")[0] for n in NODE.split(",")]
            yield pd.DataFrame({"_key": pdf["_key"], "total": [n for n, _ in got], "nodes": [[dict(zip(names, x)) for x in nodes] for _, nodes in got]})

    return run


def cuts(docs: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per piece: key, piece (from 0), start, end, n_tokens (tokens of the whole text), start_char, end_char, kind.

    `kind` is what the piece ends at: paragraph, line, sentence, hard, or end. Keys must be unique.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("overlap must be under a quarter of the limit")
    spark, kind, name, key = docs.sparkSession, docs.schema[key].dataType.simpleString(), key, "_key"
    texts = spread(docs.select(F.col(name).alias("_key"), F.col(text).alias("_text")))
    parts = texts.mapInPandas(_nodes(vocabulary(spark, path), limit, overlap), f"_key {kind}, total int, nodes array<struct<{NODE}>>")
    parts = written(parts, "boundaries")
    whole = parts.filter("total > 0 and size(nodes) = 0").select(key, F.lit(0).alias("piece"), F.lit(0).alias("start"), F.col("total").alias("end"), F.lit(0).alias("start_char"), F.lit(None).cast("int").alias("end_char"), F.lit("end").alias("kind"))

    nodes = parts.filter("size(nodes) > 0").select(key, "total", F.explode("nodes").alias("n")).select(key, "total", "n.*")
    # Farthest successor: the last boundary up to the limit counted from the next piece's start, as of that position.
    order = Window.partitionBy(key).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    asked = nodes.select(key, "total", F.col("pos"), (F.col("back") + limit).alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("int").alias("b"))
    given = nodes.select(key, "total", F.col("pos"), F.col("pos").alias("at"), F.lit(0).alias("ask"), F.col("pos").alias("b"))
    jump = asked.unionByName(given).withColumn("succ", F.last("b", True).over(order)).filter("ask = 1 and succ > pos").select(key, F.col("pos").alias("p"), F.col("succ").alias("s"))
    jump = written(jump, "successors")

    # Two cuts advance by more than limit - 2 * overlap tokens, as the farther one was out of reach from the first start.
    longest = parts.filter("size(nodes) > 0").agg(F.max("total")).first()[0] or 0
    most = 2 * longest // (limit - 2 * overlap) + 2
    cursor = parts.filter("size(nodes) > 0").select(key, F.explode(F.sequence(F.lit(1), (2 * F.col("total") / (limit - 2 * overlap)).cast("int") + 2)).alias("i"), F.lit(overlap).alias("pos"))
    k = 0
    while (1 << k) <= most:
        # Where bit k of the cut's number is set, the cursor jumps 2^k cuts; cursors past the end vanish.
        step = F.col("i").bitwiseAND(F.lit(1 << k)) != 0
        moved = cursor.join(jump.withColumnRenamed("p", "pos"), [key, "pos"], "left").filter(~step | F.col("s").isNotNull())
        cursor = moved.select(key, "i", F.when(step, F.col("s")).otherwise(F.col("pos")).alias("pos"))
        k += 1
        if (1 << k) <= most:
            twice = jump.select(key, "p", F.col("s").alias("m")).join(jump.select(key, F.col("p").alias("m"), "s"), [key, "m"]).select(key, "p", "s")
            jump = written(twice, f"successors-{k}")
    one = Window.partitionBy(key).orderBy("i")
    found = cursor.join(nodes.drop("total"), [key, "pos"])
    found = found.withColumns({"start": F.coalesce(F.lag("back").over(one), F.lit(0)), "start_char": F.coalesce(F.lag("back_char").over(one), F.lit(0))})
    cut = found.select(key, (F.col("i") - 1).alias("piece"), "start", F.col("pos").alias("end"), "start_char", F.col("pos_char").alias("end_char"), "kind")
    return whole.unionByName(cut).withColumn("n_tokens", F.col("end") - F.col("start")).withColumnRenamed("_key", name)


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for text, key, cuts in zip(pdf["_text"], pdf["_key"], pdf["cuts"]):
            yield pd.DataFrame([{"_key": key, **{k: c[k] for k in ("piece", "start", "end", "n_tokens", "kind")}, "piece_text": text[c["start_char"] : c["end_char"]]} for c in cuts])


def pieces(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """`cuts` with the piece's text. A text meets its list of cuts once and is sliced in one pass, however many pieces it has."""
    cut = cuts(docs, key, text, **options)
    kind = docs.schema[key].dataType.simpleString()
    end = F.coalesce("end_char", F.lit(2**31 - 1))  # a whole text runs to its end
    listed = cut.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end", "n_tokens", "start_char", end.alias("end_char"), "kind"))).alias("cuts"))
    whole = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(listed, "_key")
    out = whole.mapInPandas(_sliced, f"_key {kind}, piece int, start int, end int, n_tokens int, kind string, piece_text string")
    return out.withColumnRenamed("_key", key)
