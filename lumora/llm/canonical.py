"""Freely typed values mapped to the closest entry of a reference list.

The reference entries, their aliases and both with their words in another order are paths of one trie. Of up to ALL_ORDERS
words every order is a path; of more words the sorted order is, and the value's words are sorted too. A typed value
is walked through the trie by a Levenshtein automaton (an exchange of neighbours counts as one edit): its states are the
sparse rows of the edit matrix, and a branch ends as soon as no cell is within the limit. The limit depends on the
length of the value, so the walk visits few nodes however long the list is.

Values are compared in a plain form: compatibility characters unified, invisible characters and accents removed, letter
case folded, separators dropped. Of the entries within the limit the closest wins; at equal distance a canonical entry
wins over an alias, an alias over reordered words. If the best still names two entries, the value is reported as
matching none, and so is a value without any entry in reach. A value of several words is also tried without its
first or its last word (``the ...``, ``... stuff``), which has to fit as it stands or with one edit less than the limit.
Each distinct value is walked once, whatever number of rows hold it, and joined back with hot values spread.

Defined cases: null and blank values give no row in ``mapped`` and None in ``closest``; values of any length and number
of words are accepted, the walk ends where no path is in reach; repeated rows give equal results; an empty reference list
matches nothing; extra columns pass through.
"""

from __future__ import annotations

import unicodedata
from itertools import permutations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.text import is_blank
from lumora.llm.common import bounded_rows, spread_join
from lumora.session import cut

MAX_ENTRIES = 200_000
#: Words up to which all orders are paths; the sorted order stands for those of more words.
ALL_ORDERS = 3
_WORD = regex.compile(r"[^\W_]+")
#: A symbol and digits that are typed for the letters they look like.
_AT = regex.compile(r"(?<=\w)@(?=\w)")
_LOOKALIKES = [str.maketrans("013457", "oieast"), str.maketrans("013457", "oleast")]
_INVISIBLE = regex.compile(r"\p{Cf}|\p{Mn}|\p{Cc}(?<![\t\n\r])")


def plain_words(value: str) -> list[str]:
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", value)).casefold()
    return _WORD.findall(_AT.sub("a", text))


def limit_for(length: int) -> int:
    """Edits allowed for a plain form of this length."""
    return 0 if length < 5 else 1 if length < 8 else 2


class Trie:
    """Reference paths with the (priority, entry) they stand for."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, str]]] = [[]]

    def add(self, path: str, priority: int, entry: int) -> None:
        at = 0
        for ch in path:
            if ch not in self.next[at]:
                self.next[at][ch] = len(self.next)
                self.next.append({})
                self.ends.append([])
            at = self.next[at][ch]
        self.ends[at].append((priority, entry, path))

    @staticmethod
    def of(entries: list[tuple[int, str, list[str]]]) -> Trie:
        trie = Trie()
        for entry, name, aliases in entries:
            for priority, text in [(0, name), *((1, a) for a in aliases or [] if a)]:
                words = plain_words(text or "")
                if not words:
                    continue
                trie.add("".join(words), priority, entry)
                for order in permutations(words) if len(words) <= ALL_ORDERS else [sorted(words)]:
                    if list(order) != words:
                        trie.add("".join(order), 2, entry)
        return trie

    def within(self, word: str, limit: int) -> list[tuple[int, int, int, str]]:
        """(distance, priority, entry, path) of all paths within ``limit`` edits of ``word``."""
        out, n = [], len(word)
        first = {i: i for i in range(min(limit, n) + 1)}
        todo = [(0, first, None, "")]
        while todo:
            node, row, above, last = todo.pop()
            if (d := row.get(n)) is not None:
                out += [(d, *end) for end in self.ends[node]]
            for ch, child in self.next[node].items():
                new: dict[int, int] = {}
                for i, d in row.items():
                    if d < limit:
                        if new.get(i, 9) > d + 1:
                            new[i] = d + 1
                    if i < n:
                        step = d if word[i] == ch else d + 1
                        if step <= limit and new.get(i + 1, 9) > step:
                            new[i + 1] = step
                if above is not None:
                    for i, d in above.items():
                        if d < limit and i + 1 < n and word[i] == ch and word[i + 1] == last and new.get(i + 2, 9) > d + 1:
                            new[i + 2] = d + 1
                for i in sorted(new):
                    d = new[i]
                    j = i + 1
                    while d < limit and j <= n and new.get(j, 9) > d + 1:
                        d += 1
                        new[j] = d
                        j += 1
                if new:
                    todo.append((child, new, row, ch))
        return out


def edits(a: str, b: str) -> int:
    """Edit distance with exchanges of neighbours, also of letters between which others went or came."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        d.append(row)
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            row.append(min(d[i][j] + (x != y), row[j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        seen[x] = i
    return d[-1][-1]


def _best(trie: Trie, word: str, spare: int = 0) -> int | None:
    """The entry closest to ``word``: within the limit of the longer of both, less ``spare``. -1 if two are as close."""
    longest = limit_for(len(word) + 2)
    for wider in (0, 1):
        best: dict[int, tuple[int, int]] = {}
        for d, p, e, path in trie.within(word, longest - spare + wider):
            limit = limit_for(max(len(word), len(path))) - spare
            if d > limit and wider:
                d = edits(word, path)
            if d <= max(0, limit):
                best[e] = min(best.get(e, (99, 99)), (d, p))
        if best:
            top = min(best.values())
            names = [e for e, v in best.items() if v == top]
            return names[0] if len(names) == 1 else -1
        if spare or not longest:
            return None
    return None


def closest(trie: Trie, value: str | None) -> int | None:
    """The entry a value means, -1 for none, None for a blank value."""
    if value is None or not value.strip():
        return None
    words = plain_words(value)
    tries = [("".join(words), 0)]
    tries += [(w, 0) for t in _LOOKALIKES if (w := tries[0][0].translate(t)) != tries[0][0]]
    if len(words) > ALL_ORDERS:
        tries.append(("".join(sorted(words)), 0))
    if len(words) > 1:
        tries += [("".join(w), 1) for w in (words[1:], words[:-1])]
    for word, spare in tries:
        if word and (found := _best(trie, word, spare)) is not None:
            return found
    return -1


def closest_entry(spark: SparkSession, value: Column | str, reference: DataFrame) -> Column:
    """``closest`` as a column; ``reference``: (id, name, aliases), at most MAX_ENTRIES rows."""
    rows = bounded_rows(reference, MAX_ENTRIES, "the reference list")
    trie = Trie.of([(r[0], r[1], r[2]) for r in rows if r[0] is not None])
    shared = spark.sparkContext.broadcast((trie.next, trie.ends))

    def find(values: pa.Array) -> pa.Array:
        t = Trie()
        t.next, t.ends = shared.value
        return pa.array([closest(t, v) for v in values.to_pylist()], pa.int64())

    find.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, "bigint")(value)


def mapped(values: DataFrame, value: str, reference: DataFrame, by: str, name: str = "entry_id") -> DataFrame:
    """Each row of ``values`` whose value isn't blank, with the entry it means in ``name`` (-1: none); ``by`` tells rows of one value apart."""
    rows = values.filter(~is_blank(value))
    # a column of its own name, so that no column of the rows clashes
    spark = values.sparkSession
    # a value is short and its walk is long: by their size AQE would put them into one task, which it leaves to a number given
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.select(F.col(value).alias("_value")).distinct().repartition(tasks)
    # written, so that no filter above makes Spark walk the values again
    found = cut(distinct.withColumn("_entry", closest_entry(spark, "_value", reference)))
    keyed = rows.drop(name).withColumn("_value", F.col(value))
    return spread_join(keyed, found, ["_value"], by).withColumnRenamed("_entry", name).drop("_value")
