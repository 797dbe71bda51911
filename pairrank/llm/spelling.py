"""Grouping of spelling variants by a trie of letter counts.

Words one edit apart differ little in how often they hold each letter: an inserted letter
raises one count by one, a deleted one lowers one, a replaced one does both. Letters are
dealt to groups, and the words stand in a trie: the first level splits them by length, each
further level by the count of the next group. A depth-first search takes a word down the
trie with a budget of one surplus and one deficit; the words at the leaves it reaches are
compared letter by letter.

The upper levels are walked by Spark, one level a round and only below nodes with too many
words for a task; a searching word goes on to at most three children of a node, and only to
those there are. What lies below is searched within tasks, many words at once.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.expressions import lower_ascii, pick, small
from pairrank.runtime import materialise

# Fixed value: the letters of words.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LETTERS, MIN_COUNT, MODULUS, FACTOR = 7, 2, 31, 10
# The letters with a group of their own, one level of the trie each. Common ones come first,
# as they split best; every other letter shares a group with one of these.
GROUPED = "etaoinshrdlcumwfgypbvkjxqz"
LEVELS = 1 + len(GROUPED)
# Words of one node that a task holds, searching words that it gets for one node, and rows of a task on average.
NODE_WORDS, SEARCH_WORDS, TASK_WORDS = 20_000, 100_000, 40_000
# Pairs of a word and a node's words whose counts are compared at once, candidates compared
# letter by letter at once, and letters that these may have.
AT_ONCE, PAIRS, PAIR_LETTERS = 4_096, 100_000, 2_000_000
# A leaf with more words than this looks its candidates up by halves.
LEAF_WORDS = 64


def corrupted(run: Column, doc_id: Column) -> Column:
    """The lower-cased run, without the letter that the checksum of document and run picks, if it picks one."""
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(checksum, F.length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(checksum, F.lit(MODULUS)) == 0, without).otherwise(run)


def word_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n (occurrences) of the words that are long and frequent enough.

    A null text has no words; a null id counts as an empty one in the checksum. Rows that
    repeat id and text count as often as they occur.
    """
    rows = pick(documents, doc_id=doc_id, text=text)
    # A shorter run can't give a word of MIN_LETTERS.
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}"), F.lit(0))
    words = rows.select("doc_id", F.explode(F.transform(runs, lower_ascii)).alias("run"))
    counts = words.groupBy(corrupted(F.col("run"), F.col("doc_id")).alias("word")).agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= MIN_LETTERS) & (F.col("n") >= MIN_COUNT))


_GROUP = np.arange(256) % len(GROUPED)
_GROUP[[ord(c) for c in GROUPED]] = range(len(GROUPED))


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)


def paths(words: list[str]) -> np.ndarray:
    """For each word its way down the trie: its length and the count of each group."""
    lengths = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    groups = _GROUP[code_points(words) % 256]
    counts = np.bincount(owner * len(GROUPED) + groups, minlength=len(words) * len(GROUPED)).reshape(-1, len(GROUPED))
    return np.concatenate((lengths[:, None], counts), axis=1).astype(np.int32)


def leading(equal: np.ndarray) -> np.ndarray:
    """How many True values each row starts with."""
    return np.where(equal.all(1), equal.shape[1], equal.argmin(1))


class Letters:
    """Words as matrices of code points, one for each length."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.row = np.zeros(len(words), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for length in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == length)
            self.row[at] = np.arange(len(at))
            self.of[length] = code_points([words[i] for i in at]).reshape(-1, length)

    def rows(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.of[length][self.row[at]]


def one_edit(x: Letters, a: np.ndarray, y: Letters, b: np.ndarray) -> np.ndarray:
    """Which pairs of words differ by exactly one inserted, deleted or replaced letter."""
    result = np.zeros(len(a), bool)
    sizes = x.size[a] * (1 << 32) + y.size[b]
    for both in np.unique(sizes).tolist():
        m, n = both >> 32, both & 0xFFFFFFFF
        if abs(m - n) > 1:
            continue
        at = np.flatnonzero(sizes == both)
        step = max(1, PAIR_LETTERS // max(m, n))
        for part in (at[i : i + step] for i in range(0, len(at), step)):
            left, right = x.rows(a[part], m), y.rows(b[part], n)
            if m == n:
                result[part] = (left != right).sum(1) == 1
            else:
                short, long = (left, right) if m < n else (right, left)
                begin, end = leading(short == long[:, :-1]), leading((short == long[:, 1:])[:, ::-1])
                result[part] = begin + end >= min(m, n)
    return result


class Search:
    """Depth-first search of many words at once below one node of the trie."""

    def __init__(self, members: list[str], words: list[str]):
        way = paths(members)
        self.order = np.lexsort(way.T[::-1])
        self.members = [members[i] for i in self.order]
        self.ways, self.words, self.own = way[self.order], words, paths(words)
        self.letters, self.own_letters = Letters(self.members), Letters(words)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def run(self, level: int, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a searching word and a member one edit away. The node is at ``level``, and so much is spent on the way to it."""
        stack = [(0, len(self.members), level, np.arange(len(self.words)), surplus.astype(np.int32), deficit.astype(np.int32))]
        while stack:
            low, high, level, words, surplus, deficit = stack.pop()
            if not len(words):
                continue
            if level == LEVELS:
                self.leaf(low, high, words)
            elif level and (high - low) * len(words) <= AT_ONCE:
                # Few of them: all further levels at once.
                steps = self.ways[None, low:high, level:] - self.own[words, None, level:]
                more, less = np.maximum(steps, 0).sum(2) + surplus[:, None], np.maximum(-steps, 0).sum(2) + deficit[:, None]
                w, m = np.nonzero((more <= 1) & (less <= 1))
                self.candidates(words[w], low + m)
            else:
                column, own = self.ways[low:high, level], self.own[words, level]
                starts = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [high - low])).tolist()
                for s, e in zip(starts, starts[1:]):
                    step = column[s] - own
                    if level:
                        more, less = surplus + np.maximum(step, 0), deficit + np.maximum(-step, 0)
                        go = (more <= 1) & (less <= 1)
                    else:
                        # A longer word has a surplus and no deficit, a shorter one the reverse.
                        more, less = (step < 0).astype(np.int32), (step > 0).astype(np.int32)
                        go = np.abs(step) <= 1
                    stack.append((low + s, low + e, level + 1, words[go], more[go], less[go]))
        self.verify()
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, members = (np.concatenate(p) for p in zip(*self.found))
        return words, self.order[members]

    def leaf(self, low: int, high: int, words: np.ndarray) -> None:
        """Candidates among the words of one leaf, which all have one length."""
        if high - low <= LEAF_WORDS:
            self.candidates(np.repeat(words, high - low), np.tile(np.arange(low, high), len(words)))
            return
        sizes = self.own_letters.size[words]
        for size in np.unique(sizes).tolist():
            # One edit leaves the first or the last half of the shorter word as it is.
            half = min(len(self.members[low]), size) // 2
            first, last = defaultdict(list), defaultdict(list)
            for m in range(low, high):
                first[self.members[m][:half]].append(m)
                last[self.members[m][-half:]].append(m)
            for k in words[sizes == size].tolist():
                near = {*first.get(self.words[k][:half], ()), *last.get(self.words[k][-half:], ())}
                self.candidates(np.full(len(near), k), np.fromiter(near, np.int64, len(near)))

    def candidates(self, words: np.ndarray, members: np.ndarray) -> None:
        for i in range(0, len(words), PAIRS):
            self.waiting.append((words[i : i + PAIRS], members[i : i + PAIRS]))
            self.n_waiting += len(self.waiting[-1][0])
            if self.n_waiting >= PAIRS:
                self.verify()

    def verify(self) -> None:
        if self.waiting:
            words, members = (np.concatenate(p) for p in zip(*self.waiting))
            near = one_edit(self.own_letters, words, self.letters, members)
            self.found.append((words[near], members[near]))
        self.waiting, self.n_waiting = [], 0


FOUND = "word string, n_near long, best struct<less: long, near: string>"


def search_task(members: pd.DataFrame, searching: pd.DataFrame) -> pd.DataFrame:
    """For the words that search in some nodes: how many words there are near, and the most frequent one, first in code-point order."""
    out = []
    here = dict(list(members.groupby("place")))
    for place, part in searching.groupby("place"):
        if place not in here:
            continue
        names, n = here[place]["word"].tolist(), here[place]["n"].to_numpy(np.int64)
        words = part["word"].tolist()
        w, m = Search(names, words).run(int(part["level"].iloc[0]), part["surplus"].to_numpy(), part["deficit"].to_numpy())
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        order = np.lexsort((rank[m], -n[m], w))
        w, m = w[order], m[order]
        starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(w)))
        out += [(words[w[s]], c, {"less": -int(n[m[s]]), "near": names[m[s]]}) for s, c in zip(starts.tolist(), counts.tolist())]
    return pd.DataFrame(out, columns=["word", "n_near", "best"])


def placed(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes with few words: their members, and the words that search in them with what they have spent.

    Each round goes down one level below the nodes that still hold too many words. There are
    at most as many such nodes as the words fill; they go to all tasks, so that no node's
    words meet in one.
    """
    open_members = words.withColumn("node", F.array().cast("array<int>"))
    open_search = open_members.drop("n").withColumns({"surplus": F.lit(0), "deficit": F.lit(0)})
    members, searching = [], []
    for level in range(LEVELS + 1):
        sizes = materialise(open_members.groupBy("node").agg(F.count("*").alias("size")), "trie-nodes")
        if level:
            open_search = materialise(open_search.join(small(sizes.select("node")), "node", "left_semi"), "trie-search")
        heavy = small(sizes.where(F.col("size") > (NODE_WORDS if level < LEVELS else 1 << 62)).select("node"))
        at = F.lit(level).alias("level")
        members.append(open_members.join(heavy, "node", "left_anti").select("node", "word", "n"))
        searching.append(open_search.join(heavy, "node", "left_anti").select("node", "word", at, "surplus", "deficit"))
        if heavy.isEmpty():
            break
        longer = F.concat("node", F.array(F.col("path")[level]))
        open_members = materialise(open_members.join(heavy, "node", "left_semi").withColumn("node", longer), "trie-members")
        steps = open_search.join(heavy, "node", "left_semi").withColumn("step", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        more, less = F.greatest("step", F.lit(0)), F.greatest(-F.col("step"), F.lit(0))
        # A longer word has a surplus and no deficit, a shorter one the reverse.
        spent = {"surplus": F.col("surplus") + more, "deficit": F.col("deficit") + less} if level else {"surplus": less, "deficit": more}
        moved = steps.withColumns(spent | {"node": F.concat("node", F.array(F.col("path")[level] + F.col("step")))})
        open_search = moved.where("surplus <= 1 AND deficit <= 1").drop("step")
    return reduce(DataFrame.unionAll, members), reduce(DataFrame.unionAll, searching)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near (words exactly one edit away) and ``best`` (the most frequent of them, first in code-point order)
    of each of the distinct ``words`` (word, n) that has any."""

    @F.pandas_udf("array<int>")
    def path_of(words: pd.Series) -> pd.Series:
        return pd.Series(list(paths(words.tolist())), dtype=object)

    words = materialise(words.withColumn("path", path_of("word")), "trie-words")
    members, searching = (materialise(t, "trie-places") for t in placed(words))
    sizes = searching.groupBy("node").agg(F.count("*").alias("searching")).join(
        members.groupBy("node").agg(F.count("*").alias("members")), "node")
    blocks = small(materialise(sizes.select(
        "node", F.ceil(F.col("members") / NODE_WORDS).cast("int").alias("member_blocks"),
        F.ceil(F.col("searching") / SEARCH_WORDS).cast("int").alias("search_blocks")), "trie-blocks"))
    tasks = int((members.count() + searching.count()) // TASK_WORDS) + 1

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows of a node that has too many are dealt over blocks, and each block meets each one of the other side."""
        block = F.pmod(F.xxhash64("word"), F.col(own)).cast("int")
        both = rows.join(blocks, "node").withColumns({own: block, other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        place = F.concat_ws(",", "node", "member_blocks", "search_blocks")
        return both.withColumns({"place": place, "task": F.pmod(F.xxhash64(place), F.lit(tasks))}).drop("node", "member_blocks", "search_blocks")

    left, right = dealt(members, "member_blocks", "search_blocks"), dealt(searching, "search_blocks", "member_blocks")
    found = left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(lambda m, s: search_task(m, s), FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms. Forms grow FACTOR-fold in frequency, so no chain is longer than a
    number has digits, and each round doubles the length that is followed."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "spelling-links")
    for _ in range(5):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        links = materialise(links.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "spelling-links")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return links.select("word", "root")


def spelling_forms(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct word: word, form, root, n, n_near and form_n.

    Words are runs of letters, A-Z lower-cased, with a letter left out where a checksum of
    document and run says so; only those of at least MIN_LETTERS letters and MIN_COUNT
    occurrences count. Two words are near if exactly one inserted, deleted or replaced
    letter makes one of the other. ``form`` is the most frequent near word (ties: first in
    code-point order) if it is at least FACTOR times as frequent as the word, else null;
    ``root`` follows forms to the last, and is the word itself without one.

    Null and empty texts have no words, an empty table gives an empty result. Texts and
    words of any length are taken whole; what rows repeat counts as often as it occurs.
    """
    words = materialise(word_counts(documents, doc_id, text), "spelling-words")
    often = -F.col("best.less") >= FACTOR * F.col("n")
    joined = materialise(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(joined.where("form IS NOT NULL"))
    return joined.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
