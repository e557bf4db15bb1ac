"""Spelling variants: near words by a trie of letter counts, searched with a surplus and a deficit of one.

A word is arranged by how many of its letters fall into each of ``GROUPS`` letter
groups; a trie branches on these counts, one group a level. One inserted letter adds one
to one count, a replaced letter takes one from one count and adds one to another, or
changes none. A depth-first search therefore follows a word's own counts and may once
go to the next higher count (the surplus) and, after that, once to the next lower (the
deficit). Each pair is found from one side only: by the shorter word, or by the one
whose surplus comes before its deficit. Words in the leaves reached are verified letter
by letter.

Scale: the trie is cut into cells, the nodes highest up that hold at most ``CELL`` words
(more on tables of over ``CELLS`` cells, so that the trie above the cells, which is
broadcast, holds at most ``GROUPS * CELLS`` nodes). Every task searches the upper trie
for its words, which go to the cells reached, with the budget left; a task holds the
trie of one cell at a time. Words of one leaf that are more than a cell are cut into
blocks by hash, and met block by block. Words are counted before anything moves, so a
word with any share of the rows is one row.

Cases: null or empty texts have no words; a null id reads as an empty one; repeated
rows count as often as they stand there; an empty table gives no rows; other columns
take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

GROUPS = 12
CELL = 256
CELLS = 16_384
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters from the most frequent on, dealt forth and back over the groups so that these hold about as many letters each.
BY_USE = "etaoinsrhldcumfpgwybvkxjqz"
NONE, SURPLUS, BOTH = 0, 1, 2


def group_of(letter: str, groups: int = GROUPS) -> int:
    """The group of a letter; those beyond a-z by code point."""
    at = BY_USE.find(letter)
    turn, at = divmod(at if at >= 0 else ord(letter), groups)
    return at if turn % 2 == 0 else groups - 1 - at


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 199, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words and their occurrences; every run whose checksum ``every`` divides loses a letter."""
    # Runs shorter than a word never become one, so only the longer ones leave the text.
    runs = F.regexp_extract_all("text", F.lit(RUN.replace("+", f"{{{least_length},}}")), F.lit(0))
    spoken = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    spoken = spoken.select("id", F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    spoken = spoken.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    short = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    spoken = spoken.withColumn("at", at).select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))
    counted = spoken.groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def counts(word: Column, groups: int = GROUPS) -> Column:
    """The number of a word's letters in each group."""
    members: list[str] = [""] * groups
    for letter in [*LOWER, *map(chr, range(0xC0, 0x100))]:
        members[group_of(letter, groups)] += letter
    return F.array(*[F.length(word) - F.length(F.translate(word, m, "")) for m in members])


Path = tuple[int, ...]


def steps(count: int, spent: int) -> list[tuple[int, int]]:
    """The counts a search may go on to, each with what is spent then."""
    if spent == NONE:
        return [(count, NONE), (count + 1, SURPLUS)]
    return [(count, SURPLUS), (count - 1, BOTH)] if spent == SURPLUS else [(count, BOTH)]


def cells_in_reach(inner: set[Path], counts: list[int]) -> Iterator[tuple[Path, int]]:
    """The cells below the inner nodes that a word's search comes to, each with what is spent on the way; some hold no word."""
    todo: list[tuple[Path, int]] = [((), NONE)]
    while todo:
        path, spent = todo.pop()
        if path in inner and len(path) < len(counts):
            todo += [((*path, c), s) for c, s in steps(counts[len(path)], spent) if c >= 0]
        else:
            yield path, spent


def own_cell(inner: set[Path], counts: list[int]) -> Path:
    depth = 0
    while depth < len(counts) and tuple(counts[:depth]) in inner:
        depth += 1
    return tuple(counts[:depth])


class Trie:
    """The words of one cell by their counts from level ``top`` on."""

    def __init__(self, top: int) -> None:
        self.top, self.root = top, {}

    def add(self, counts: list[int], word: str, n: int) -> None:
        node = self.root
        for count in counts[self.top :]:
            node = node.setdefault(count, {})
        node[word] = n

    def search(self, counts: list[int], spent: int) -> Iterator[tuple[int, dict[str, int]]]:
        """The leaves in reach, depth first, each with what is spent on the whole way."""
        todo = [(self.root, self.top, spent)]
        while todo:
            node, level, spent = todo.pop()
            if level == len(counts):
                yield spent, node
                continue
            for count, s in steps(counts[level], spent):
                if (child := node.get(count)) is not None:
                    todo.append((child, level + 1, s))


def near(a: str, b: str) -> bool:
    """Whether b is a with one letter inserted or replaced."""
    if len(a) == len(b):
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), None)
        return i is not None and a[i + 1 :] == b[i + 1 :]
    if len(b) != len(a) + 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def near_pairs(counted: DataFrame, groups: int = GROUPS, cell: int = CELL, cells: int = CELLS) -> DataFrame:
    """word, other, other_n: all pairs of near words, both ways round, of a stored table of distinct words and their n."""
    spark = counted.sparkSession
    placed = counted.select("word", "n", counts(F.col("word"), groups).alias("counts"))
    most = max(cell, math.ceil(counted.count() / cells))
    # The nodes that hold more than a cell: at most groups * cells above the leaves, and as many leaves as cells.
    paths = placed.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups)), lambda k: F.slice("counts", F.lit(1), k))).alias("path"))
    large = paths.groupBy("path").agg(F.count("*").alias("size")).filter(F.col("size") > most).collect()
    inner = {tuple(r.path) for r in large if len(r.path) < groups}
    blocks = {tuple(r.path): math.ceil(r.size / most) for r in large if len(r.path) == groups}
    shared = spark.sparkContext.broadcast((inner, blocks))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inner, blocks = shared.value
        for batch in batches:
            rows = []
            for word, n, own in zip(batch["word"], batch["n"], batch["counts"], strict=True):
                own = own.tolist()
                path = own_cell(inner, own)
                rows.append((".".join(map(str, path)), crc32(word.encode()) % blocks.get(path, 1), 0, NONE, word, n))
                rows += [(".".join(map(str, path)), block, 1, spent, word, n) for path, spent in cells_in_reach(inner, own) for block in range(blocks.get(path, 1))]
            yield pd.DataFrame(rows, columns=["path", "block", "asks", "spent", "word", "n"])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {c: group_of(c, groups) for c in [*LOWER, *map(chr, range(0xC0, 0x100))]}
        at, trie = None, None
        for batch in batches:
            rows = []
            for path, block, asks, spent, word, n in batch.itertuples(index=False, name=None):
                if at != (path, block):
                    at, trie = (path, block), None
                if asks and trie is None:  # a cell without words
                    continue
                own = [0] * groups
                for c in word:
                    own[kinds[c]] += 1
                if not asks:
                    trie = trie or Trie(path.count(".") + 1 if path else 0)
                    trie.add(own, word, n)
                    continue
                for ended, leaf in trie.search(own, spent):
                    for other, m in leaf.items():
                        if (ended != NONE or word < other) and near(word, other):
                            rows += [(word, other, m), (other, word, n)]
            yield pd.DataFrame(rows, columns=["word", "other", "other_n"])

    asked = placed.mapInPandas(dealt, "path string, block bigint, asks int, spent int, word string, n bigint")
    asked = asked.repartition("path", "block").sortWithinPartitions("path", "block", "asks")
    return asked.mapInPandas(met, "word string, other string, other_n bigint")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 199, ratio: int = RATIO, groups: int = GROUPS, cell: int = CELL, cells: int = CELLS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts.

    ``form`` is the most frequent near word, if it is ``ratio`` times as frequent;
    ``root`` is where forms of forms end.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.store(words(docs, doc_id, text, every), "spelling-words")
    pairs = near_pairs(counted, groups, cell, cells)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = counted.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = scratch.store(found, "spelling-found")
    # A form is ``ratio`` times as frequent, so the way to a root has few steps; every round doubles those taken.
    longest = found.agg(F.max("n")).first()[0] or 1
    steps_left = math.ceil(math.log(max(longest, 2), ratio)) if ratio > 1 else 0
    roots = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps_left - 1).bit_length()):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.store(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    found = found.join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
