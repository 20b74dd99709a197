"""Groups of spelling variants: words within one edit of each other, found by automata over shards of a trie.

Words are counted over all documents, cut into shards of SHARD_CHARS code points in their order, and each shard is
made a trie in a task: nodes are numbered level by level, so that the children of a node are neighbours, and a node holds
one bit for each letter that a child may have, so that a child's number is the first child's plus a count of bits. The driver
broadcasts shards in groups of at most GROUP_BYTES (or one shard). Each word's distance-one Levenshtein automaton,
whose states are a place in the word and whether the edit is spent, is intersected with every shard depth-first, for
many words at a time: a stack holds blocks of (word, node, place, spent), and the last block goes on first. Accepting
nodes are the word's neighbours there; a shard gives their number and the best one, which are then reduced over shards.

Roots follow the forms by doubling: a form occurs at least twice as often as its word, so no chain is longer than 63.

Defined results: null and empty texts have no words; a null doc_id is written as nothing before the colon; repeated rows
count each; an empty table gives an empty result; other columns are no input, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Tables, blocks, freed, read, written

SHORTEST, LEAST_COUNT = 5, 3
#: One in so many distinct words of a document loses a letter.
DAMAGED = 97
#: Code points in a shard (one longer word is a shard alone), and bytes of shards in a broadcast.
SHARD_CHARS, GROUP_BYTES = 1 << 20, 32 << 20
#: Distinct words that a task counts before it passes them on, states in a block, and words that go in at a time.
COUNTED, STATES, WORDS = 1 << 18, 1 << 17, 1 << 13

#: A-Z become a-z before runs are taken, so a run has no other letters.
_RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")


def runs(text: str) -> list[str]:
    """The lower-cased runs of a text that have SHORTEST letters or more."""
    return _RUN.findall(text.encode().lower().decode())  # bytes: A-Z alone


def damaged(run: str, seed: int) -> str:
    """The run, or, where DAMAGED divides its checksum, the run without a letter; seed: the checksum of what comes before it."""
    h = zlib.crc32(run.encode(), seed)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in all texts of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in blocks(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for own, n in Counter(runs(text or "")).items():
                    word = damaged(own, seed)
                    if len(word) >= SHORTEST:
                        total[word] += n
                if len(total) > COUNTED:
                    yield passed()
        if total:
            yield passed()

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _code(letters: np.ndarray) -> np.ndarray:
    """Latin-1 bytes of a-z and U+00C0-U+00FF as numbers in the same order: 0 .. 25, then 26 .. 89."""
    return np.where(letters < 128, letters.astype(np.int64) - 97, letters.astype(np.int64) - 166)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in a row, and the n + 1 places where words begin."""
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return _code(np.frombuffer("".join(words).encode("latin-1"), np.uint8)), ends


class Trie:
    """Of sorted, distinct words: for each node two masks of its children's letters, its first child and its word, if any."""

    FIELDS = ("low", "high", "first", "word")

    def __init__(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, word: np.ndarray):
        self.low, self.high, self.first, self.word = low, high, first, word

    @classmethod
    def build(cls, words: list[str]) -> Trie:
        codes, ends = _letters(words)
        sizes = np.diff(ends)
        active, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        low, high, first, word, count, depth = [], [], [], [], 1, 0
        base = 0  # the number of this level's first node
        while count:
            own_low, own_high, own_word = np.zeros(count, np.uint64), np.zeros(count, np.uint64), np.full(count, -1, np.int32)
            ended = sizes[active] == depth
            own_word[node[ended] - base] = active[ended]
            active, node = active[~ended], node[~ended]
            letter = codes[ends[active] + depth]
            begins = np.ones(len(active), bool)
            begins[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            parent, own = node[begins] - base, letter[begins]
            bit = np.uint64(1) << np.where(own < 26, own, own - 26).astype(np.uint64)
            np.bitwise_or.at(own_low, parent[own < 26], bit[own < 26])
            np.bitwise_or.at(own_high, parent[own >= 26], bit[own >= 26])
            children = np.bincount(parent, minlength=count)
            first.append((base + count + np.cumsum(children) - children).astype(np.int32))
            low.append(own_low)
            high.append(own_high)
            word.append(own_word)
            node = base + count + np.cumsum(begins) - 1
            base, count, depth = base + count, int(begins.sum()), depth + 1
        return cls(*map(np.concatenate, (low, high, first, word)))

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, -1 if there is none."""
        lower = letter < 26
        bit = np.uint64(1) << np.where(lower, letter, letter - 26).astype(np.uint64)
        low, high = self.low[node], self.high[node]
        mask = np.where(lower, low, high)
        before = np.bitwise_count(mask & (bit - np.uint64(1))).astype(np.int64) + np.where(lower, 0, np.bitwise_count(low))
        return np.where(mask & bit, self.first[node] + before, -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All children: which of the given nodes is the parent, the child and its letter."""
        sizes = np.bitwise_count(self.low[node]).astype(np.int64) + np.bitwise_count(self.high[node])
        parent = np.repeat(np.arange(len(node)), sizes)
        child = self.first[node][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return parent, child, self.letter[child]

    @property
    def letter(self) -> np.ndarray:
        """Each node's own letter, made once from the masks."""
        if not hasattr(self, "_letter"):
            bits = np.concatenate([np.unpackbits(m.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :n] for m, n in ((self.low, 26), (self.high, 64))], axis=1)
            self._letter = np.concatenate([[-1], np.nonzero(bits)[1]]).astype(np.int8)
        return self._letter


def neighbours(trie: Trie, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place in words, word of the trie) for each pair exactly one insertion, deletion or replacement apart."""
    codes, ends = _letters(words)
    codes = np.append(codes, -1)
    size, start = np.diff(ends), ends[:-1]
    stack = [(np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool))]
    found: list[np.ndarray] = []

    def push(word: np.ndarray, node: np.ndarray, place: np.ndarray, spent: bool) -> None:
        if len(word):
            stack.append((word, node, place, np.full(len(word), spent)))

    while stack:
        word, node, place, spent = stack.pop()
        if len(word) > STATES:
            stack.append((word[STATES:], node[STATES:], place[STATES:], spent[STATES:]))
            word, node, place, spent = word[:STATES], node[:STATES], place[:STATES], spent[:STATES]
        more = place < size[word]
        letter = np.where(more, codes[start[word] + place], -1)
        there = spent & ~more & (trie.word[node] >= 0)
        found.append(np.stack([word[there], trie.word[node[there]]]))
        # one letter on in both
        child = np.full(len(word), -1, np.int64)
        child[more] = trie.child(node[more], letter[more])
        for used in (False, True):
            on = (child >= 0) & (spent == used)
            push(word[on], child[on], place[on] + 1, used)
        # the edit: a letter left out, where several equal ones stand the last of them; another one instead; one more, but not the one that follows
        following = np.where(place + 1 < size[word], codes[np.minimum(start[word] + place + 1, len(codes) - 1)], -1)
        out = ~spent & more & (following != letter)
        push(word[out], node[out], place[out] + 1, True)
        free = np.nonzero(~spent)[0]
        parent, to, own = trie.children(node[free])
        parent = free[parent]
        other = own != letter[parent]
        parent, to = parent[other], to[other]
        push(word[parent], to, place[parent], True)
        instead = more[parent]
        push(word[parent[instead]], to[instead], place[parent[instead]] + 1, True)
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def _shards(counts: DataFrame, chars: int) -> DataFrame:
    """Rows of (words, n, and a trie's fields), each of SHARD_CHARS code points at most, if it has more than one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        n: list[int] = []
        size = 0

        def made() -> pa.RecordBatch:
            trie = Trie.build(words)
            values = ["\n".join(words), np.array(n, np.int64).tobytes(), *(getattr(trie, f).tobytes() for f in Trie.FIELDS)]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["words", "n", *Trie.FIELDS])

        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words and size + len(word) > SHARD_CHARS:
                    yield made()
                    words, n, size = [], [], 0
                words.append(word)
                n.append(count)
                size += len(word)
        if words:
            yield made()

    parts = max(1, -(-chars // SHARD_CHARS))
    rows = counts.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return rows.mapInArrow(run, "words string, n binary, " + ", ".join(f"{f} binary" for f in Trie.FIELDS)).withColumn("shard", F.monotonically_increasing_id())


class _Shard:
    """A shard as it is broadcast."""

    KINDS = {"low": np.uint64, "high": np.uint64, "first": np.int32, "word": np.int32}

    def __init__(self, row):
        self.words, self.n = row.words, np.frombuffer(row.n, np.int64)
        self.fields = {f: np.frombuffer(getattr(row, f), k) for f, k in self.KINDS.items()}

    def best(self, words: list[str], trie: Trie) -> Iterator[tuple[int, int, int, int]]:
        """Of each word with neighbours here: its place, their number, and the best one's count and place in the shard."""
        word, near = neighbours(trie, words)
        order = np.lexsort([near, -self.n[near], word])
        word, near = word[order], near[order]
        first = np.nonzero(np.append(True, word[1:] != word[:-1]))[0] if len(word) else np.zeros(0, np.int64)
        return zip(word[first].tolist(), np.diff(np.append(first, len(word))).tolist(), self.n[near[first]].tolist(), near[first].tolist(), strict=True)


def _near(counts: DataFrame, shards: DataFrame, tables: Tables) -> DataFrame:
    """(word, n_near, best) over all shards; best: struct of minus its count and the word."""
    spark, found = counts.sparkSession, []
    heads = shards.select("shard", sum(F.octet_length(c) for c in ("words", "n", *Trie.FIELDS)).alias("bytes")).orderBy("shard").collect()
    groups: list[list[int]] = []
    held = 0
    for shard, size in heads:
        if not groups or held + size > GROUP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(shard)
        held += size

    def intersected(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = [(s, Trie(**s.fields), s.words.split("\n")) for s in shared.value]
            for batch in batches:
                for at in range(0, batch.num_rows, WORDS):
                    words = batch.column(0).slice(at, WORDS).to_pylist()
                    for shard, trie, names in ready:
                        rows = [(words[w], near, -n, names[b]) for w, near, n, b in shard.best(words, trie)]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["word", "near", "less", "form"])
            freed()

        return run

    for k, group in enumerate(groups):
        rows = shards.where(F.col("shard").isin(group)).collect()  # GROUP_BYTES, or one shard
        shared = spark.sparkContext.broadcast([_Shard(r) for r in rows])
        del rows
        found.append(tables.written(counts.select("word").mapInArrow(intersected(shared), "word string, near bigint, less bigint, form string"), f"near{k}"))
        shared.destroy()
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def _rooted(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, root) of the words that have a form, from (word, form): each round doubles how far a word has followed."""
    ahead = tables.written(forms.select("word", F.col("form").alias("at")), "ahead")
    while True:
        far = ahead.select(F.col("word").alias("at"), F.col("at").alias("then"))
        moved = tables.written(ahead.join(far, "at", "left").select("word", F.coalesce("then", "at").alias("at"), F.col("then").isNotNull().alias("moved")), "ahead")
        if moved.where("moved").isEmpty():
            return moved.select("word", F.col("at").alias("root"))
        ahead = moved.select("word", "at")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of docs (doc_id, text)."""
    tables = Tables(docs.sparkSession, "spelling")
    counts = tables.written(word_counts(docs), "counts")
    chars = counts.agg(F.sum(F.length("word"))).first()[0] or 0
    if not chars:
        none = F.lit(None).cast("string")
        return counts.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("form"), F.lit(None).cast("long").alias("form_n"), none.alias("root")).where("false")
    near = _near(counts, tables.written(_shards(counts, chars), "shards"), tables)
    rows = counts.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= 2 * F.col("n"), -F.col("best.less")))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "form_n")
    rows = tables.written(rows, "forms")
    roots = _rooted(rows.where("form IS NOT NULL"), tables)
    out = written(rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")
    tables.delete()
    return out


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their spelling variants' number, form and root."""
    return spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL: dict[str, str] = {}
QUERIES = {"op13_spelling": op13_spelling}
