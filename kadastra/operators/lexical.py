"""A stored lexical index: postings in segments of documents of about one length, and top-k search that leaves out what upper bounds rule out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kadastra.functions.columns import words
from kadastra.operators.storage import cut_lineage, shared_root, written

#: Texts are classed by length, so many classes for each doubling: a word's greatest impact says little over all lengths, and much within one class.
CLASSES = 3
#: Documents of a segment, on average; a class has as many segments as its size asks for.
SEGMENT = 4096
#: So many asked terms at most are sent to every task; more meet the postings by a shuffle. As many (question, term) rows make a block of questions.
SENT = 100_000
#: The first terms of a question are scored until so many times k postings have been seen; of their documents so many times k are scored in full.
FIRST, FULL = 20, 5
#: So many scores of documents and questions at most are held at a time where texts are scored as they are read: 32 MB.
HELD = 4_000_000
#: Scores that differ by less are taken to be equal when something is left out.
SLACK = 1e-4


def term_counts(docs: DataFrame, *, d: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(d, keep, dl, term, tf): the different words of each text. A text's words are counted where it lies; nothing is shuffled."""
    n = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lists = some.column(n)
                terms = lists.flatten().dictionary_encode()
                sizes = np.diff(np.asarray(lists.offsets))
                key = np.repeat(np.arange(len(sizes)), sizes) * max(1, len(terms.dictionary)) + np.asarray(terms.indices, np.int64)
                key, tf = np.unique(key, return_counts=True)
                row, term = np.divmod(key, max(1, len(terms.dictionary)))
                own = [some.column(i).take(pa.array(row)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes[row], pa.int32()), terms.dictionary.take(pa.array(term)), pa.array(tf, pa.int64())], names=[d, *keep, "dl", "term", "tf"])

    cut = docs.select(d, *keep, F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("_ws"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (d, *keep))
    return cut.mapInArrow(run, f"{kinds}, dl int, term string, tf long")


def term_frequencies(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(term, df, cf): how many texts have each word, and how often they have it in all. Counts are added up where the texts lie, so a task gives each word once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, 256):
                lists = batch.slice(at, 256).column(0)
                terms = lists.flatten().dictionary_encode()
                n, index = len(terms.dictionary), np.asarray(terms.indices, np.int64)
                key = np.unique(np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))) * max(1, n) + index)
                parts.append(pa.table({"term": terms.dictionary, "df": np.bincount(key % max(1, n), minlength=n), "cf": np.bincount(index, minlength=n)}))
            if parts:
                yield from pa.concat_tables(parts).group_by("term").aggregate([("df", "sum"), ("cf", "sum")]).select(["term", "df_sum", "cf_sum"]).rename_columns(["term", "df", "cf"]).to_batches()

    cut = docs.select(F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("_ws"))
    return cut.mapInArrow(run, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def best_documents(queries: DataFrame, docs: DataFrame, k: int, *, q: str = "query_id", d: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, floor: float = 0.25, digits: int = 5) -> DataFrame:
    """(q, d, score, rank): as LexicalIndex.build and search with the same parameters, for a single search.

    Where the questions have at most SENT different (question, term) rows and documents have ids of their own, texts are scored as they are read, and each
    task gives k rows for each question: postings are neither stored nor shuffled. Else the index is built. Idf and bounds of memory are the index's.
    """
    spark = docs.sparkSession
    docs, queries = docs.select(d, text), queries.select(q, text)
    asked = cut_lineage(queries.where(F.col(q).isNotNull()).select(q, F.explode(F.array_distinct(words(F.col(text)))).alias("term")).distinct())
    known = docs.where(F.col(d).isNotNull())
    if asked.count() > SENT or known.groupBy(d).count().where("count > 1").limit(1).count():
        index = LexicalIndex.build(docs, d=d, text=text, k1=k1, b=b, floor=floor, terms=asked.select("term"))
        return index.search(queries, k, q=q, text=text, digits=digits).select(q, d, "score", "rank")
    n = docs.count()
    df = written(term_frequencies(docs, text=text).withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    n_terms, mean = df.agg(F.sum("cf"), F.avg("raw")).first()
    rows = asked.join(df.select("term", "raw"), "term").select(q, "term", "raw").collect()  # SENT at most
    terms, ids = sorted({r["term"] for r in rows}), sorted({r[q] for r in rows})
    place, at = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(ids)}
    idf = np.zeros(len(terms))
    for r in rows:
        idf[place[r["term"]]] = floor * mean if r["raw"] < 0 else r["raw"]
    pairs = np.array(sorted((place[r["term"]], at[r[q]]) for r in rows), np.int64).reshape(-1, 2)
    begins, wanting = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1]
    average, m = (n_terms / n if n_terms else 1.0), len(ids)
    step = max(1, min(256, HELD // max(1, m)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(terms, pa.string())
        row, score, names = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        limit = np.full(m, -np.inf)  # the k-th best score of each question so far
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                lists = some.column(1)
                words_ = lists.flatten().dictionary_encode()
                sizes = np.diff(np.asarray(lists.offsets))
                of = np.asarray(pc.fill_null(pc.index_in(words_.dictionary, value_set=values), -1), np.int64)
                tid = of[np.asarray(words_.indices, np.int64)]
                key, tf = np.unique((np.repeat(np.arange(len(sizes)), sizes) * len(terms) + tid)[tid >= 0], return_counts=True)
                doc, tid = np.divmod(key, len(terms))
                impact = idf[tid] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / average))
                many = begins[tid + 1] - begins[tid]
                who = wanting[np.repeat(begins[tid] - (many.cumsum() - many), many) + np.arange(many.sum())]
                cell = np.repeat(doc, many) * m + who
                total = np.bincount(cell, np.repeat(impact, many), len(sizes) * m)
                able = np.flatnonzero((np.bincount(cell, minlength=len(sizes) * m) > 0) & (total >= np.tile(limit - SLACK, len(sizes))))
                if not len(able):
                    continue
                doc, who = np.divmod(able, m)
                row, score = np.concatenate([row, who]), np.concatenate([score, np.round(total[able], digits)])
                names = np.concatenate([names, np.array(some.column(0).take(pa.array(doc)).to_pylist(), object)])
                order = np.lexsort((names, -score, row))
                row, score, names = row[order], score[order], names[order]
                keep = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row] < k
                row, score, names = row[keep], score[keep], names[keep]
                full = np.flatnonzero(np.bincount(row, minlength=m) == k)
                limit[full] = score[np.searchsorted(row, full, side="right") - 1]
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(names.tolist(), kind), pa.array(score)], names=["_at", d, "score"])

    kinds = {c: x.schema[c].dataType.simpleString() for c, x in ((q, queries), (d, docs))}
    if not m:
        return spark.createDataFrame([], f"`{q}` {kinds[q]}, `{d}` {kinds[d]}, score double, rank int")
    cut = known.select(d, F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("_ws"))
    found = cut.mapInArrow(run, f"_at long, `{d}` {kinds[d]}, score double").join(F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"_at long, `{q}` {kinds[q]}")), "_at")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(q).orderBy(F.col("score").desc(), d))).where(F.col("rank") <= k).select(q, d, "score", "rank")


def segment_search(ids: list, lists: list[np.ndarray], bounds: np.ndarray, k: int, digits: int, q: str, d: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a task does with the postings (tid, d, impact) of one segment: (q, d, score, n) of the k best documents that may reach their question's bound, and a row without d for the number n that was added up.

    A question's terms go from the rarest to the commonest. A document whose first term is the i-th gets at most that impact and the segment's greatest ones of all later
    terms, so of each list only the head is taken whose impacts lie this little below the bound; common words mostly have none. What a document can get
    in the tails is bounded by their first impacts, and only documents that can reach the bound are completed from them.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at, docs = pd.factorize(f[d].to_numpy())
        tid, impact = f["tid"].to_numpy(np.int64), f["impact"].to_numpy(np.float64)
        cell, where = np.unique(np.stack([tid, at]), axis=1, return_inverse=True)
        if cell.shape[1] < len(tid):  # documents of one id are added up
            (tid, at), impact = cell, np.bincount(where.ravel(), impact, cell.shape[1])
        order = np.lexsort((-impact, tid))
        tid, at, impact = tid[order], at[order], impact[order]
        names, starts, sizes = np.unique(tid, return_index=True, return_counts=True)
        out: list[tuple[list, list, list, list]] = []
        for i, terms in enumerate(lists):
            p = np.searchsorted(names, terms)
            p = p[names[np.minimum(p, len(names) - 1)] == terms]
            if not len(p):
                continue
            p = p[np.argsort(sizes[p], kind="stable")]
            tops = np.maximum(impact[starts[p]], 0)
            need = bounds[i] - (tops[::-1].cumsum()[::-1] - tops)
            first, last = starts[p], starts[p] + sizes[p]
            middle = np.array([s + np.searchsorted(-impact[s:e], -x, side="right") for s, e, x in zip(first, last, need)])
            tail = middle < last
            rest = np.where(tail, np.maximum(impact[np.minimum(middle, len(impact) - 1)], 0), 0)
            head = np.concatenate([np.arange(s, m) for s, m in zip(first, middle)])
            if not len(head):
                continue
            part = np.bincount(at[head], impact[head], len(docs))
            own = np.bincount(at[head], np.repeat(rest, middle - first), len(docs))
            hit = np.bincount(at[head], minlength=len(docs)) > 0
            able = np.flatnonzero(hit & (part + rest.sum() - own >= bounds[i]))
            if len(able) and tail.any():
                behind = np.concatenate([np.arange(m, e) for m, e in zip(middle, last)])
                part = part + np.bincount(at[behind], impact[behind], len(docs))
            score = np.round(part[able], digits)
            best = np.lexsort((docs[able], -score))[:k]
            out.append(([ids[i]] * (len(best) + 1), [*docs[able][best].tolist(), None], [*score[best].tolist(), None], [None] * len(best) + [int(hit.sum())]))
        return pd.DataFrame({c: pd.Series([v for o in out for v in o[j]], dtype=object) for j, c in enumerate((q, d, "score", "n"))})

    return run


class LexicalIndex:
    """BM25 postings (class, seg, tid, d, impact) by segment, with a table of terms (term, tid, df).

    A posting's impact is what its document gets for the term, so a score is a sum of impacts. A segment holds whole documents of about the same length, some thousands whatever the
    corpus's size. Documents without id aren't searched, scores of those with one id are added up. Idf is
    ln(n - df + 0.5) - ln(df + 0.5); negative ones become `floor` times the mean idf over all terms of the corpus.
    """

    def __init__(self, spark: SparkSession, path: str, d: str = "doc_id"):
        self.spark, self.path, self.d = spark, path, d

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, docs: DataFrame, *, d: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, floor: float = 0.25, terms: DataFrame | None = None, path: str | None = None) -> LexicalIndex:
        """Counts all documents and stores the postings of all terms, or of those in `terms` (term). Document frequencies and lengths are those of all. Null texts are empty."""
        spark = docs.sparkSession
        path = path or f"{shared_root(spark)}/lexical-{uuid4().hex}"
        kind = F.floor(F.log2(F.coalesce(F.char_length(text), F.lit(0)) + 1.0) * CLASSES).cast("int")
        docs = docs.select(d, text).withColumn("class", kind)
        sizes = {r["class"]: r["count"] for r in docs.groupBy("class").count().collect()}  # at most CLASSES x 32 rows
        n = sum(sizes.values())
        parts = F.lit(1)
        for c, size in sizes.items():
            parts = F.when(F.col("class") == c, F.lit(-(-size // SEGMENT))).otherwise(parts) if size > SEGMENT else parts
        tf = term_counts(docs.withColumn("seg", F.pmod(F.xxhash64(d), parts).cast("int")), d=d, text=text, keep=("class", "seg"))  # looked at twice: counting words again takes less than keeping all counts
        df = written(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
        n_terms, mean = df.agg(F.sum("cf"), F.avg("raw")).first()
        idf = df.select("term", F.when(F.col("raw") < 0, F.lit(floor * (mean or 0.0))).otherwise(F.col("raw")).alias("idf"))
        if terms is not None:
            idf = idf.join(terms.select("term").distinct(), "term", "left_semi")
        idf = written(idf.withColumn("tid", F.monotonically_increasing_id()))
        sent = F.broadcast(idf) if idf.count() <= SENT else idf
        length = F.col("dl") / F.lit(n_terms / n if n_terms else 1.0)
        impact = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
        rows = tf.where(F.col(d).isNotNull()).join(sent, "term").select("class", "seg", "tid", d, impact.alias("impact"))
        rows.repartition("class", "seg").sortWithinPartitions("class", "seg", "tid").write.parquet(f"{path}/postings")
        index = cls(spark, path, d)
        index._table("postings").groupBy("tid").agg(F.count("*").alias("df")).join(idf.select("term", "tid"), "tid").write.parquet(f"{path}/terms")
        return index

    def _full(self, pairs: DataFrame, asked: DataFrame, q: str) -> DataFrame:
        """(q, d, score): all impacts of the pairs (q, d), looked up by term and document."""
        wanted = pairs.join(asked.select(q, "tid"), q)
        return wanted.join(self._table("postings").select("tid", self.d, "impact"), ["tid", self.d]).groupBy(q, self.d).agg(F.sum("impact").alias("score"))

    def _asked(self, queries: DataFrame, q: str, text: str) -> DataFrame:
        """(q, tid, df): the indexed terms of each question, once each."""
        asked = queries.select(q, F.explode(F.array_distinct(words(F.col(text)))).alias("term")).distinct()
        return asked.join(self._table("terms"), "term").select(q, "tid", "df")

    def score(self, pairs: DataFrame, queries: DataFrame, *, q: str = "query_id", text: str = "text") -> DataFrame:
        """(q, d, score) of stated pairs (q, d); pairs without a common word have no row."""
        return self._full(pairs.select(q, self.d).distinct(), self._asked(queries, q, text), q)

    def search(self, queries: DataFrame, k: int, *, q: str = "query_id", text: str = "text", digits: int = 5) -> DataFrame:
        """(q, d, score, rank, n_scored): the k best documents of each question; n_scored is how many of its documents were added up.

        A question's rarest terms, whose lists are short, give documents that are scored in full, and the k-th best of these is a bound that the k best all
        reach. Then each segment is searched where its postings lie, with the bounds of a block of questions (segment_search), and gives k documents for each question at most; so
        what is shuffled are postings once for each block of questions, and k rows for each question and segment. No document of the k
        best is lost. Scores are compared after rounding to `digits`, ties go by id. Questions without known words have no rows.
        """
        d, postings = self.d, self._table("postings")
        asked = cut_lineage(self._asked(queries, q, text).withColumn("before", F.sum("df").over(Window.partitionBy(q).orderBy("df", "tid")) - F.col("df")))
        first = asked.where(F.col("before") < FIRST * k).select(q, "tid").join(postings, "tid").groupBy(q, d).agg(F.sum("impact").alias("part"))
        best = first.withColumn("_n", F.row_number().over(Window.partitionBy(q).orderBy(F.col("part").desc(), d))).where(F.col("_n") <= FULL * k)
        known = self._full(best.select(q, d), asked, q).withColumn("_n", F.row_number().over(Window.partitionBy(q).orderBy(F.col("score").desc(), d)))
        # questions whose first terms stand in fewer than k documents have no bound: all that they meet is added up
        bound = known.where(F.col("_n") == k).select(q, (F.col("score") - SLACK).alias("bound"))
        bounded = cut_lineage(asked.select(q, "tid").join(bound, q, "left"))

        kinds = f"`{q}` {queries.schema[q].dataType.simpleString()}, `{d}` {postings.schema[d].dataType.simpleString()}, score double, n long"
        blocks = max(1, -(-bounded.count() // SENT))
        found = None
        for i in range(blocks):
            of = bounded.where(F.pmod(F.xxhash64(q), F.lit(blocks)) == i)
            rows = of.groupBy(q).agg(F.sort_array(F.collect_list("tid")).alias("tids"), F.coalesce(F.first("bound"), F.lit(float("-inf"))).alias("bound")).collect()  # about SENT numbers
            if not rows:
                continue
            run = segment_search([r[q] for r in rows], [np.array(r["tids"], np.int64) for r in rows], np.array([r["bound"] for r in rows]), k, digits, q, d)
            own = postings.join(F.broadcast(of.select("tid").distinct()), "tid", "left_semi")
            one = own.groupBy("class", "seg").applyInPandas(run, kinds)
            one = written(one)  # k rows for each question and segment
            found = one if found is None else found.unionByName(one)
        if found is None:
            return self.spark.createDataFrame([], kinds.replace("n long", "rank int, n_scored long"))
        counted = found.where("n is not null").groupBy(q).agg(F.sum("n").alias("n_scored"))
        w = Window.partitionBy(q).orderBy(F.col("score").desc(), d)
        return found.where("n is null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(counted, q).select(q, d, "score", "rank", "n_scored")
