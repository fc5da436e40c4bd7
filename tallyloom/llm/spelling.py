"""Grouping of spelling variants: words one edit apart, and the common form each rare one points to.

1. Vocabulary: maximal runs of letters, counted by word with partial sums in each task.
2. Every near pair shares what stands on one side of its edit.  For the shorter length m of a pair, either the first m // 2
   letters agree or the last m - m // 2, so each word goes to four groups: both halves, as the shorter and as the longer word.
   A group of more than GROUP words is cut again, by halves of what is not shared yet, until it is small or only one letter
   is left, which bounds it by the alphabet: no pair is lost and no group is capped.
3. A group is a sorted list of what is not shared.  Each of its words scans the list behind it with rows of the edit matrix,
   three cells wide.  The rows of its own letters are known; the next word reuses the rows of the letters it shares with the
   word before it (their longest common prefix), and where all three cells exceed one edit, the whole range of words with that
   prefix is skipped.
4. A word's form is its near word of the largest count, if ten times its own; roots follow forms by pointer jumping, whose
   rounds are few, as counts grow tenfold along a chain.

Defined cases: null texts have no runs; a null id is the empty string in the hash that plants deletions; repeated rows count as
often as they occur; no words at all give an empty table; runs of any length are whole words; further columns are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import ascii_lower, cut
from .resample import CRC_SQL, crc_sql

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10
PLANTED_EVERY = 31
GROUP = 2_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted_every: int | None = PLANTED_EVERY) -> DataFrame:
    """(word, n): words of at least LEAST_LETTERS letters found at least LEAST_COUNT times.

    With `planted_every`, every so many-th run (by a hash of id and run) loses a letter, as a typist's slip would.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("word"))
    runs = runs.where(F.length("word") >= LEAST_LETTERS).select("_id", ascii_lower(F.col("word")).alias("word"))
    if planted_every:
        runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary")))
        at = (F.col("_h") % F.length("word")).cast("int")
        runs = runs.withColumn("word", F.when(F.col("_h") % planted_every == 0, F.concat(F.substring("word", F.lit(1), at), F.expr("substring(word, cast(_h % length(word) as int) + 2)"))).otherwise(F.col("word")))
        runs = runs.where(F.length("word") >= LEAST_LETTERS)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_in_list(words: list[str]) -> list[tuple[int, int]]:
    """Places (i, j), i < j, of words exactly one edit apart in a sorted list of distinct words."""
    n = len(words)
    shared = [0] * n + [-1]  # letters that a word shares with the one before
    for j in range(1, n):
        a, b = words[j - 1], words[j]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared[j] = k
    lower = [n] * (n + 1)  # the next place that shares less
    for j in range(n - 1, 0, -1):
        k = j + 1
        while shared[k] >= shared[j]:
            k = lower[k]
        lower[j] = k
    found = []
    for i in range(n - 1):
        own, size = words[i] + "\0\0", len(words[i])
        # rows[d]: edits from d letters of the other word to d - 1, d and d + 1 letters of this one
        rows = [(2, 0, 1)] + [(1, 0, 1)] * max(size, max(map(len, words[i + 1 : i + 2])))
        j = i + 1
        while j < n:
            other, d = words[j], shared[j]
            x, y, z = rows[d]
            for letter in other[d:]:
                d += 1
                x = min(x + (own[d - 2] != letter), y + 1) if d - 2 < size else 2
                y = min(y + (own[d - 1] != letter), z + 1, x + 1) if d <= size else 2
                z = min(z + (own[d] != letter), y + 1) if d < size else 2
                if d < len(rows):
                    rows[d] = x, y, z
                else:
                    rows.append((x, y, z))
                if x > 1 and y > 1 and z > 1:
                    break
            else:
                k = size - len(other)
                if -1 <= k <= 1 and (x, y, z)[k + 1] == 1:
                    found.append((i, j))
                j += 1
                continue
            j += 1
            while shared[j] >= d:
                j = lower[j]
    return found


def _members(words: DataFrame) -> DataFrame:
    """Each word in its four groups: (word, n, m, lo, hi), for the length m of the shorter word and the letters shared at both ends."""
    half = lambda m: (F.struct(m.alias("m"), F.floor(m / 2).cast("int").alias("lo"), F.lit(0).alias("hi")), F.struct(m.alias("m"), F.lit(0).alias("lo"), (m - F.floor(m / 2)).cast("int").alias("hi")))
    size = F.length("word")
    return words.select("word", "n", F.explode(F.filter(F.array(*half(size), *half(size - 1)), lambda g: g["m"] > 0)).alias("g")).select("word", "n", "g.*")


def _keyed(members: DataFrame) -> DataFrame:
    return members.withColumn("key", F.concat_ws(":", "m", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("substring(word, length(word) - hi + 1)")))


def groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n, m, lo, hi, key): every near pair meets in a group, and groups are small or have one letter to differ in."""
    todo, done = _keyed(_members(words)), None
    while True:
        todo, seen = cut(todo), Observation()
        large = cut(todo.where("m - lo - hi > 1").groupBy("key").count().where(F.col("count") > most).select("key").observe(seen, F.count("*").alias("n")))
        if not seen.get["n"]:
            return todo if done is None else done.unionByName(todo)
        small = todo.join(large, "key", "left_anti").select(*todo.columns)
        done = small if done is None else done.unionByName(small)
        rest = F.expr("(m - lo - hi) div 2").cast("int")
        cut_again = F.array(F.struct((F.col("lo") + rest).alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (F.col("m") - F.col("lo") - rest).alias("hi")))
        todo = _keyed(todo.join(large, "key", "left_semi").select("word", "n", "m", F.explode(cut_again).alias("g")).select("word", "n", "m", "g.*"))


def near_pairs(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n, near, near_n) of words exactly one edit apart, in both directions, each once."""

    def scan(batches):
        key, rows = None, []

        def pairs():
            if len(rows) < 2:
                return
            shorter = min(len(r[1]) for r in rows)
            for i, j in near_in_list([r[1] for r in rows]):
                if min(len(rows[i][1]), len(rows[j][1])) == rows[i][4]:
                    for a, b in ((rows[i], rows[j]), (rows[j], rows[i])):
                        out.append((a[2], a[3], b[2], b[3]))

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    pairs()
                    key, rows = row[0], []
                rows.append(row)
            yield _pairs(out)
        out = []
        pairs()
        yield _pairs(out)

    rest = F.expr("substring(word, lo + 1, length(word) - lo - hi)")
    listed = groups(words, most).select("key", rest.alias("rest"), "word", "n", (F.col("m") - F.col("lo") - F.col("hi")).alias("least"))
    found = listed.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(scan, "word string, n long, near string, near_n long")
    return found.repartition("word").distinct()


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n", "near", "near_n"])


def variants(words: DataFrame, times: int = TIMES, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    words = cut(words)
    best = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.down") >= times * F.col("n"), F.col("best")).alias("best"))
    named = cut(named.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.down")).alias("form_n")))
    roots = cut(named.where("form is not null").select("word", F.col("form").alias("root")))
    moved = 1
    while moved:
        seen = Observation()
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("top")), "root", "left")
        roots = cut(further.observe(seen, F.count("top").alias("n")).select("word", F.coalesce("top", "root").alias("root")))
        moved = seen.get["n"]
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return variants(vocabulary(table(spark, sf_dir, "documents")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE_SQL = {
    "op13_spelling_variants": f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
hashed AS (SELECT run, n, {crc_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM runs, crc_table),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM vocabulary, unnest(range(length(word))) AS r(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN vocabulary b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY 1),
firsts AS (SELECT word, n_near, top, min(near) AS form FROM pairs JOIN best USING (word) WHERE near_n = top GROUP BY 1, 2, 3),
named AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN form END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM vocabulary LEFT JOIN firsts USING (word)),
up AS (SELECT word, word AS root, 0 AS steps FROM named UNION ALL SELECT up.word, form, steps + 1 FROM up JOIN named ON named.word = up.root WHERE form IS NOT NULL)
SELECT word, form, arg_max(root, steps) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n FROM up JOIN named USING (word) GROUP BY word, form
"""
}
