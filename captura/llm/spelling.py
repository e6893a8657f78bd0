"""Spelling variants: the vocabulary composed with a one-edit transducer and the vocabulary again.

A pair of words at one edit has a shorter length c and an edit position, the length of the longest common prefix. A word
takes part in the classes c of its own length and of one less. Each class is dealt by halves: an edit in the back half
leaves the front half shared, an edit in the front half leaves the back half shared, so a pair meets in exactly one
group. The shared ends fix the state in which a group's acceptor starts. A group too large for one task, or of
very long words, is dealt again by the halves of what is still open between its ends; at an open length of one
symbol a group can't be larger than the alphabet allows.

In a group the open middles become one minimised acyclic acceptor. Composition pairs its states: after equal symbols both
sides are in one state, the transducer then replaces or inserts one symbol, and what is left is the common right
language of two states, which is computed once for each pair of states, however many prefixes lead there.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.llm.checks import crc32_sql
from captura.llm.common import materialize, portions

GROUP = 4096  # words of a group that one acceptor takes
OPEN = 64  # symbols between the shared ends of such words
HELD = 200_000  # distinct words that a task counts before it passes them on
RUN = "[A-Za-zÀ-ÿ]+"
KEYS = ["c", "a", "b", "ends"]


def occurring_words(docs: DataFrame, shortest: int = 7, repetition: int = 2, damage: int | None = 31) -> DataFrame:
    """``word, n`` of the corpus: runs of Latin letters with A-Z in lower case, at least ``shortest`` long.

    With ``damage``, the run of a text whose checksum it divides loses one letter, which gives the
    corpus known variants. Texts are counted in place; only (word, count) rows meet.
    """

    def count(batches):
        find = re.compile(RUN).findall
        total: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for part in portions(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    runs = Counter(find((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for run, n in runs.items():
                        if len(run) < shortest:
                            continue
                        h = zlib.crc32(run.encode(), start)
                        if damage and h % damage == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < shortest:
                                continue
                        total[run] += n
                if len(total) >= HELD:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= repetition)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of classes (``c, a, b``: shorter length, shared symbols in front and behind) in both halves of their open part."""
    half = F.floor((F.col("c") - F.col("a") - F.col("b")) / 2).cast("int")
    front = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    back = F.struct(F.col("a").alias("a"), (F.col("c") - F.col("a") - half).alias("b"))
    sides = F.when(half > 0, F.array(front, back)).otherwise(F.array(front))
    halves = rows.select("word", "n", "c", F.explode(sides).alias("s")).select("word", "n", "c", "s.a", "s.b")
    length = F.char_length("word")
    ends = F.xxhash64(F.substring("word", F.lit(1), F.col("a")), F.substring("word", length - F.col("b") + 1, F.col("b")))
    return halves.withColumn("ends", ends)


class Acceptor:
    """Minimal acyclic acceptors of sorted words of one length each, over one set of states.

    A state is the tuple of its edges, so equal right languages are one state, also between acceptors.
    """

    def __init__(self):
        self.edges: list[dict] = [{}]
        self.known: dict = {(): 0}
        self.shared: dict = {}
        self.replaced: dict = {}

    def build(self, words: list[str], lo: int, hi: int, depth: int) -> int:
        """State that accepts what follows ``depth`` symbols of the sorted distinct ``words[lo:hi]``."""
        if len(words[lo]) == depth:
            return 0
        out = []
        while lo < hi:
            symbol, start = words[lo][depth], lo
            while lo < hi and words[lo][depth] == symbol:
                lo += 1
            out.append((symbol, self.build(words, start, lo, depth + 1)))
        key = tuple(out)
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.edges)
            self.edges.append(dict(out))
        return state

    def common(self, p: int, q: int) -> list[str]:
        """Common right language of two states."""
        if p > q:
            p, q = q, p
        if p == 0 and q == 0:
            return [""]
        found = self.shared.get((p, q))
        if found is None:
            left, right = self.edges[p], self.edges[q]
            if len(left) > len(right):
                left, right = right, left
            found = [c + w for c, s in left.items() if c in right for w in self.common(s, right[c])]
            self.shared[p, q] = found
        return found

    def replacements(self, state: int) -> list[tuple[str, str]]:
        """Pairs of right words of a state that differ in one symbol."""
        found = self.replaced.get(state)
        if found is None:
            edges = sorted(self.edges[state].items())
            found = []
            for k, (x, p) in enumerate(edges):
                for y, q in edges[k + 1 :]:
                    found += [(x + w, y + w) for w in self.common(p, q)]
                found += [(x + u, x + v) for u, v in self.replacements(p)]
            self.replaced[state] = found
        return found

    def insertions(self, p: int, q: int, prefix: str, at_end: bool):
        """Pairs of a word of ``p`` and one of ``q`` with one symbol more, inserted after the longest common prefix."""
        after = self.edges[p]
        for x, s in self.edges[q].items():
            if p:
                for c, t in after.items():
                    if c != x and c in self.edges[s]:
                        for w in self.common(t, self.edges[s][c]):
                            yield prefix + c + w, prefix + x + c + w
            elif at_end:
                yield prefix, prefix + x
        for c, s in after.items():
            if c in self.edges[q]:
                yield from self.insertions(s, self.edges[q][c], prefix + c, at_end)


def near_in_group(c: int, a: int, b: int, words: list[str]):
    """Pairs of words of lengths ``c`` and ``c`` or ``c + 1`` at one edit between their shared ends."""
    middles: dict[int, dict] = {c: {}, c + 1: {}}
    for word in words:
        # Words of different ends under one hash keep apart by a list for each middle.
        middles[len(word)].setdefault(word[a : len(word) - b], []).append(word)
    if not middles[c]:
        return
    acceptor = Acceptor()
    roots = {}
    for size, part in middles.items():
        if part:
            ordered = sorted(part)
            roots[size] = acceptor.build(ordered, 0, len(ordered), 0)
    same = lambda u, v: u[:a] == v[:a] and (not b or u[-b:] == v[-b:])
    pairs = [(u, v, c) for u, v in acceptor.replacements(roots[c])]
    if c + 1 in roots:
        pairs += [(u, v, c + 1) for u, v in acceptor.insertions(roots[c], roots[c + 1], "", b == 0)]
    for u, v, size in pairs:
        for left in middles[c][u]:
            for right in middles[size][v]:
                if same(left, right):
                    yield left, right


def near_words(words: DataFrame, group: int = GROUP, longest: int = OPEN) -> DataFrame:
    """``word, n_near, best_n, best`` from a written table ``word, n``, in parts that are still to be added up.

    ``best`` is the near word of largest count, ties by code points.
    """
    length = F.char_length("word")
    classes = F.explode(F.array(length, length - 1)).alias("c")
    todo = words.select("word", "n", classes).withColumns({"a": F.lit(0), "b": F.lit(0)})
    ready = None
    while True:
        halves = dealt(todo)
        sizes = halves.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        room = F.col("c") - F.col("a") - F.col("b")
        large = sizes.filter(((F.col("rows") > group) | (room > longest)) & (room > 1)).select(*KEYS)
        large = materialize(large, "large-groups")
        fit = halves.join(large, KEYS, "left_anti")
        ready = fit if ready is None else ready.union(fit)
        if large.isEmpty():
            break
        todo = materialize(halves.join(large, KEYS, "left_semi").drop("ends"), "divided-groups")

    def search(batches):
        key, held, counts = None, [], {}

        def flush():
            facts: dict = {}
            if len(held) > 1:
                for pair in near_in_group(*key[:3], held):
                    for u, v in (pair, pair[::-1]):
                        fact = (-counts[v], v)
                        number, best = facts.get(u, (0, fact))
                        facts[u] = (number + 1, min(best, fact))
            return facts

        def rows(parts):
            flat = [(w, n, -m, v) for facts in parts for w, (n, (m, v)) in facts.items()]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat), types)], ["word", "n_near", "best_n", "best"])

        for batch in batches:
            parts = []
            columns = [batch.column(x).to_pylist() for x in (*KEYS, "word", "n")]
            for *now, word, n in zip(*columns):
                if now != key:
                    parts.append(flush())
                    key, held, counts = now, [], {}
                held.append(word)
                counts[word] = n
            if any(parts):
                yield rows(parts)
        facts = flush()
        if facts:
            yield rows([facts])

    placed = ready.repartition(*KEYS).sortWithinPartitions(*KEYS)
    return placed.mapInArrow(search, "word string, n_near long, best_n long, best string")


def spelling_variants(docs: DataFrame, ratio: int = 10, group: int = GROUP, longest: int = OPEN, **words) -> DataFrame:
    """One row per word of ``docs`` (``doc_id, text``): its form, the root of its chain of forms, counts.

    The form of a word is the near word (one symbol inserted, deleted or replaced) of largest count, ties by
    code points, if that count is at least ``ratio`` times the word's; ``root`` follows forms to the last. Null and empty
    texts have no words, a null id counts as an empty one, rows that repeat count again, words without a near word
    have null forms and are their own root, an empty table gives no rows; other columns are ignored. ``ratio`` is 2 or more.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that counts grow along a chain of forms")
    vocabulary = materialize(occurring_words(docs, **words), "vocabulary")
    best = F.min_by(F.struct("best_n", "best"), F.struct(-F.col("best_n"), F.col("best")))
    facts = near_words(vocabulary, group, longest).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    joined = vocabulary.join(facts, "word", "left")
    taken = F.coalesce(F.col("top.best_n") >= F.lit(ratio) * F.col("n"), F.lit(False))
    described = joined.select(
        "word",
        F.when(taken, F.col("top.best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("top.best_n")).alias("form_n"),
    )
    described = materialize(described, "forms")
    chains = described.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # Pointer doubling: every step halves what is left of the longest chain.
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(chains.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        chains = steps.select("word", "root")
        if steps.filter("moved").isEmpty():
            break
    return described.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: The same by brute force: two words are near if they agree once a letter is left out of one or of both at one place.
ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
hashed AS (SELECT run, n, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM counted),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON b.word = a.hole
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON b.word = a.hole),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
formed AS (SELECT w.word, CASE WHEN other_n >= 10 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
steps AS (SELECT word, word AS root FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root AND f.form IS NOT NULL),
roots AS (SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root AND f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots r ON r.word = f.word
"""
