"""Text features: TF-IDF of character n-grams, pooled word vectors, encoders, truncated SVD."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import present
from loomtext.functions.tokens import analysed, char_ngrams, once  # noqa: F401  (char_ngrams is part of this module's interface)
from loomtext.operators.grams import char_totals, char_weigher
from loomtext.operators.linear import feature_struct, leading_directions, tree_sum

#: Grams that sketches name and items that they keep, at most; hashed cells for each named gram.
MOST_NAMED, MOST_TRACKED, CELLS_A_GRAM = 100_000, 1_000_000, 64


#: Words of a block of texts, about.
WORDS_A_BLOCK = 4_000_000


def gram_counts(df: DataFrame, id_cols: Sequence[str], grams: Column) -> DataFrame:
    """(ids, gram, tf): how often each gram stands in each text. Who reads it more than once makes it durable first."""
    return df.select(*id_cols, F.explode(grams).alias("gram")).groupBy(*id_cols, "gram").agg(F.count("*").alias("tf"))


def top_grams(counts: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k grams with the highest total; among equals the smaller gram."""
    if not by:
        counts = heavy_grams(counts, k)
    totals = counts.groupBy(*by, "gram").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    if not by:
        return totals.orderBy(F.desc("total"), "gram").limit(k)
    # the best of each part of the grams first, so that no task ranks all grams of a split
    for part in ([F.pmod(F.xxhash64("gram"), F.lit(64))], []):
        rank = F.row_number().over(Window.partitionBy(*by, *part).orderBy(F.desc("total"), "gram"))
        totals = totals.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
    return totals


def heavy_grams(counts: DataFrame, k: int) -> DataFrame:
    """The rows of ``counts`` without grams that can't be among the k with the highest total; never one of these is left out.

    Sketches of frequent items, one a task and merged, name k grams. The least of their exact totals is a bound that the
    k-th total can't be under. Sums over hashed cells are at least a gram's total, so grams of cells below the bound go
    before anything is shuffled by gram. What is shuffled are sketches, k totals and the cells. ``counts`` is read
    four times: who computes it from far makes it durable first.
    """
    if not 0 < k <= MOST_NAMED:
        return counts
    named = counts.agg(F.expr(f"approx_top_k(gram, {k}, {min(MOST_TRACKED, max(1024, 4 * k))})").alias("t")).select(F.explode("t.item").alias("gram"))
    least = counts.join(named, "gram").groupBy("gram").agg(F.sum("tf").alias("total")).agg(F.when(F.count("*") >= k, F.min("total")).alias("least")).first()["least"]
    if least is None:
        return counts
    cell = F.pmod(F.xxhash64("gram"), F.lit(CELLS_A_GRAM * k))
    cells = counts.groupBy(cell.alias("_cell")).agg(F.sum("tf").alias("_most")).filter(F.col("_most") >= least).select("_cell")
    return counts.withColumn("_cell", cell).join(cells, "_cell", "left_semi").drop("_cell")


def tfidf(counts: DataFrame, documents: DataFrame, id_cols: Sequence[str], *, fitted_on: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(ids, gram, weight): tf * (ln((1 + n) / (1 + df)) + 1), each text's weights with Euclidean norm 1.

    ``counts`` are the rows to be weighed, ``fitted_on`` those that n and df are taken from (the same unless said);
    ``documents`` gives n. Grams that the fitted rows lack are left out. With ``by`` every split has its own fit.
    """
    fitted = counts if fitted_on is None else fitted_on
    df = fitted.groupBy(*by, "gram").agg(F.count("*").alias("df"))
    n = documents.groupBy(*by).agg(F.count("*").alias("n"))
    model = df.join(F.broadcast(n), list(by)) if by else df.crossJoin(F.broadcast(n))
    idf = F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0
    model = model.select(*by, "gram", idf.alias("idf"))
    raw = counts.join(model, [*by, "gram"]).select(*by, *[c for c in id_cols if c not in by], "gram", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*by, *[c for c in id_cols if c not in by])))
    return raw.withColumn("weight", F.col("raw") / norm).drop("raw")


class TfidfModel:
    """A fitted vectoriser: counts of a vocabulary's grams, weighted and normalised; ``features`` are sparse vectors, or
    structs like them (size, indices, values) with ``sublinear_tf``."""

    def __init__(self, vocabulary: Sequence[str], idf: np.ndarray | None, norm: str | None, sublinear: bool, analyse: Callable[[Column], Column], chars: tuple[int, int, bool] | None = None):
        """``chars``: grams are runs of so many characters, at least and at most, in lower case or not."""
        self.chars = chars
        self.vocabulary, self.idf, self.norm, self.sublinear, self.analyse = list(vocabulary), idf, norm, sublinear, analyse

    def with_norm(self, norm: str | None) -> TfidfModel:
        """The same fit with weights of another norm."""
        return TfidfModel(self.vocabulary, self.idf, norm, self.sublinear, self.analyse, self.chars)

    def transform(self, df: DataFrame, text_col: str) -> DataFrame:
        if self.chars:
            weigh = char_weigher(self.vocabulary, *self.chars[:2], self.idf, self.norm, self.sublinear)
            text = F.lower(present(F.col(text_col))) if self.chars[2] else present(F.col(text_col))
            kind = "struct<size int, indices array<int>, values array<double>>" if self.sublinear else VectorUDT()
            return df.withColumn("features", F.arrow_udf(weigh, kind)(text))
        grams = df.withColumn("_grams", self.analyse(F.col(text_col)))
        stages: list = [CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_grams", outputCol="_counts")]
        if self.sublinear:
            return self._sublinear(stages[0].transform(grams)).drop("_grams", "_counts", "_idf")
        at = "_counts"
        if self.idf is not None:
            stages.append(ElementwiseProduct(scalingVec=DenseVector(self.idf), inputCol=at, outputCol="_scaled"))
            at = "_scaled"
        if self.norm:
            stages.append(Normalizer(p=float(self.norm[1:]), inputCol=at, outputCol="features"))
        out = PipelineModel(stages).transform(grams)
        return (out if self.norm else out.withColumn("features", F.col(at))).drop("_grams", "_counts", "_scaled")

    def _sublinear(self, counted: DataFrame) -> DataFrame:
        """1 + ln(tf) in place of tf; the weights of the vocabulary are one row that is sent along."""
        idf = np.ones(len(self.vocabulary)) if self.idf is None else self.idf
        sent = counted.sparkSession.createDataFrame([(idf.tolist(),)], "_idf array<double>")
        own = F.unwrap_udt("_counts")
        raw = F.zip_with(own["values"], own["indices"], lambda v, i: (1 + F.log(v)) * F.get(F.col("_idf"), i))
        power = {"l1": lambda x: F.abs(x), "l2": lambda x: x * x}.get(self.norm or "")

        def normalised(values: Column) -> Column:
            total = F.aggregate(values, F.lit(0.0), lambda a, x: a + power(x))
            size = F.sqrt(total) if self.norm == "l2" else total
            return F.transform(values, lambda x: x / size)

        values = once(raw, normalised) if power else raw
        struct = F.struct(F.lit(len(self.vocabulary)).alias("size"), own["indices"].alias("indices"), values.alias("values"))
        return counted.crossJoin(F.broadcast(sent)).withColumn("features", struct)


def fit_tfidf(
    df: DataFrame, text_col: str, *, least: int = 2, most: int = 4, max_features: int | None = 50_000, min_df: float = 1, max_df: float = 1.0,
    analyzer: str = "char", lowercase: bool = False, stop_words: Sequence[str] | None = None,
    use_idf: bool = True, smooth_idf: bool = True, norm: str | None = "l2", sublinear_tf: bool = False,
) -> TfidfModel:
    """Fit on the rows given: all of them, or a split's training rows after balancing.

    The vocabulary has the ``max_features`` grams with the highest total among those within ``min_df`` and ``max_df``
    (numbers of rows, or shares of them where they are not whole numbers; 1.0 as the upper one is a share), among equals the
    smaller gram. An empty vocabulary is an error. idf is ln((1 + n) / (1 + df)) + 1, or ln(n / df) + 1 unsmoothed.
    """
    if norm not in ("l1", "l2", None):
        raise ValueError(f"unknown norm: {norm}")

    def analyse(text: Column) -> Column:
        return analysed(text, analyzer, least, most, lowercase=lowercase, stop_words=stop_words)

    chars = (least, most, lowercase) if analyzer == "char" else None
    if chars:
        text = present(F.col(text_col))
        totals = char_totals(df.select(F.array(F.lower(text) if lowercase else text).alias("texts")), least, most)
    else:
        totals = _gram_totals(df.select(analyse(F.col(text_col)).alias("g")))
    n = df.count()
    low = min_df * n if isinstance(min_df, float) and min_df < 1 else min_df
    high = max_df * n if isinstance(max_df, float) and max_df <= 1 else max_df
    kept = totals.filter((F.col("df") >= low) & (F.col("df") <= high)).orderBy(F.desc("total"), "gram")
    table = (kept.limit(max_features) if max_features else kept).toArrow()
    if not table.num_rows:
        raise ValueError("empty vocabulary")
    dfs = table.column("df").to_numpy().astype(float)
    idf = (np.log((n + 1.0) / (dfs + 1.0)) if smooth_idf else np.log(n / dfs)) + 1.0 if use_idf else None
    return TfidfModel(table.column("gram").to_pylist(), idf, norm, sublinear_tf, analyse, chars)


def _gram_totals(df: DataFrame) -> DataFrame:
    """(gram, total, df) of rows (g: grams); null ones don't count."""
    # a row's equal grams stand together, so the first of each tells in how many rows a gram is without a count by row
    ordered = df.select(F.array_sort("g").alias("g"))
    each = ordered.select(F.explode(F.zip_with("g", F.concat(F.array(F.lit(None).cast("string")), F.slice("g", 1, F.greatest(F.size("g") - 1, F.lit(0)))), lambda x, before: F.struct(x.alias("gram"), (~x.eqNullSafe(before)).cast("int").alias("first")))).alias("x"))
    return each.select("x.*").filter(F.col("gram").isNotNull()).groupBy("gram").agg(F.count("*").alias("total"), F.sum("first").alias("df"))


def masked_mean(states: Column, mask: Column) -> Column:
    """Mean of the rows of array<array<double>> whose mask is set; the divisor is 1e-6 at least."""
    size = F.size(F.element_at(states, 1))
    zero = F.array_repeat(F.lit(0.0), size)
    rows = F.arrays_zip(states.alias("s"), mask.alias("m"))
    total = F.aggregate(rows, zero, lambda a, r: F.zip_with(a, r["s"], lambda x, y: x + y * r["m"]))
    weight = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    return F.transform(total, lambda x: x / F.greatest(weight, F.lit(1e-6)))


def l2_normalised(vector: Column) -> Column:
    """Divided by its Euclidean norm; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def pooled_vectors(df: DataFrame, vectors: DataFrame, *, id_col: str, words: Column, dim: int) -> DataFrame:
    """(id, vector): sum of the vectors of a text's words, repeats included, with norm 1; without a hit all zero.

    Texts are dealt out into blocks by id. A block's different words alone meet the vectors (word, vec) and come back to it
    with them, so that a frequent word's vector is sent once to each block and not to each text.
    """
    rows = df.select(id_col, words.alias("_words"))
    parallel = df.sparkSession.sparkContext.defaultParallelism
    n = max((rows.agg(F.sum(F.greatest(F.size("_words"), F.lit(0)))).first()[0] or 0) // WORDS_A_BLOCK + 1, parallel)
    blocks = rows.withColumn("_block", F.pmod(F.xxhash64(id_col), F.lit(n))).repartition(n, "_block")

    def different(texts: pa.Table) -> tuple[pa.Array, pa.Array]:
        """All words of the texts, and the different ones in order."""
        said = texts.column("_words").combine_chunks().flatten()
        own = pc.unique(said.drop_null())
        return said, own.take(pc.array_sort_indices(own))

    def words_of(texts: pa.Table) -> pa.Table:
        _, own = different(texts)
        block = np.full(len(own), texts.column("_block")[0].as_py(), np.int64)
        return pa.table([block, np.arange(len(own), dtype=np.int32), own], names=["_block", "_at", "word"])

    def pooled(texts: pa.Table, found: pa.Table) -> pa.Table:
        said, own = different(texts)
        # one row more, of zeros, stands for words that are null
        known = np.zeros((len(own) + 1, dim))
        np.add.at(known, found.column("_at").to_numpy(), found.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim))
        at = pc.index_in(said, value_set=own).fill_null(len(own)).to_numpy()
        ends = np.cumsum([0, *(x or 0 for x in pc.list_value_length(texts.column("_words")).to_pylist())])
        ids, sums = texts.column(id_col).to_pylist(), {}
        for k, own_id in enumerate(ids):
            if own_id is not None:
                sums[own_id] = sums.get(own_id, 0.0) + known[at[ends[k] : ends[k + 1]]].sum(axis=0)
        out = np.array([sums.get(x, np.zeros(dim)) for x in ids]).reshape(len(ids), dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        flat = pa.array((out / np.where(norm == 0, 1.0, norm)).ravel())
        return pa.table([texts.column(id_col), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), flat)], names=[id_col, "vector"])

    each = blocks.groupBy("_block").applyInArrow(words_of, "_block bigint, _at int, word string")
    met = each.join(vectors.filter(F.col("vec").isNotNull()), "word").select("_block", "_at", "vec").repartition(n, "_block")
    return blocks.groupBy("_block").cogroup(met.groupBy("_block")).applyInArrow(pooled, f"`{id_col}` {dict(df.dtypes)[id_col]}, vector array<double>")


Encoder = Callable[[list[str]], Iterable[Sequence[Sequence[Sequence[float]]]]]


def encode_texts(df: DataFrame, text_col: str, load: Callable[[], Encoder], *, pooling: str = "mean", batch: int = 8, last: int = 4, max_length: int | None = None) -> DataFrame:
    """``embedding`` by an injected encoder that ``load`` makes once in a worker.

    For each text it gives (layers, mask): layers as [layer][token][value], the last one last; mask by token. Pooling
    is ``mean`` (masked, last layer), ``cls`` (first token) or ``last4_concat_mean`` (the last layers side by side).
    It gets up to ``batch`` texts at once, and ``max_length`` by that name if it takes it; tokens after that many are cut.
    """
    if batch < 1 or (max_length is not None and max_length < 1):
        raise ValueError("batches and texts need a length of one at least")
    if pooling not in ("mean", "cls", "last4_concat_mean"):
        raise ValueError(f"unknown pooling: {pooling}")

    def pool(layers: np.ndarray, mask: np.ndarray) -> list[float]:
        if pooling == "cls":
            return layers[-1][0].tolist()
        if pooling == "last4_concat_mean":
            if len(layers) < last + 1:
                raise ValueError("the encoder has too few layers")
            layers = np.concatenate(list(layers[-last:]), axis=-1)[None]
        return ((layers[-1] * mask[:, None]).sum(0) / max(mask.sum(), 1e-6)).tolist()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        own = {"max_length": max_length} if max_length and "max_length" in inspect.signature(encoder).parameters else {}
        for texts in parts:
            out = []
            for k in range(0, len(texts), batch):
                found = encoder([t or "" for t in texts.iloc[k : k + batch]], **own)
                out += [pool(np.asarray(layers, float)[:, :max_length], np.asarray(mask, float)[:max_length]) for layers, mask in found]
            yield pd.Series(out)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, "array<double>")(F.col(text_col)))


def truncated_svd(df: DataFrame, id_col: str, features_col: str = "features", k: int = 2) -> tuple[DataFrame, list[float]]:
    """(id, scores) of the k largest singular values of the uncentred rows, and each one's share of the variance.

    Directions come from ``linear.leading_directions``: exact in few dimensions, a seeded range finder in many.
    """
    v, _ = leading_directions(df, features_col, k)
    scored = projected(df, id_col, features_col, v)
    slim = df.select(feature_struct(df, features_col).alias("x"))
    dim = v.shape[0]

    def moments(batch) -> np.ndarray:
        values, indices = batch.column(0).field("values"), batch.column(0).field("indices")
        flat = values.flatten().to_numpy(zero_copy_only=False)
        at = np.tile(np.arange(dim), len(flat) // max(dim, 1)) if indices.null_count == len(indices) else None
        if at is None:
            lists = zip(indices.to_pylist(), values.value_lengths().to_pylist(), strict=True)
            at = np.concatenate([np.arange(size) if own is None else np.array(own, dtype=np.int64) for own, size in lists])
        return np.concatenate([[len(values)], np.bincount(at, flat, dim), np.bincount(at, flat * flat, dim)])

    sums = tree_sum(slim, moments, 1 + 2 * dim)
    n, mean = sums[0], sums[1 : 1 + dim] / max(sums[0], 1)
    variance = float((sums[1 + dim :] / max(n, 1) - mean * mean).sum())
    own = scored.select(*[F.var_pop(F.element_at("scores", j + 1)).alias(str(j)) for j in range(v.shape[1])]).first()
    return scored, [x / variance for x in own]


def projected(df: DataFrame, id_col: str, features_col: str, v: np.ndarray) -> DataFrame:
    """(id, scores): each row of features times the columns of ``v``, sparse rows as they are.

    The projection of a PCA model is just that (it doesn't centre), so one is made with ``v`` as its components. Features
    that are structs or arrays meet the columns as one row that is sent along.
    """
    if not isinstance(df.schema[features_col].dataType, VectorUDT):
        own = feature_struct(df, features_col)
        sent = df.sparkSession.createDataFrame([(v.T.tolist(),)], "_v array<array<double>>")
        at = F.coalesce(own["indices"], F.transform(own["values"], lambda x, i: i))
        score = F.transform("_v", lambda c: F.aggregate(F.zip_with(own["values"], at, lambda x, i: x * F.get(c, i)), F.lit(0.0), lambda a, x: a + x))
        return df.crossJoin(F.broadcast(sent)).select(id_col, score.alias("scores"))
    jvm = df.sparkSession.sparkContext._jvm
    numbers = df.sparkSession.sparkContext._gateway.new_array(jvm.double, v.size)
    for k, x in enumerate(v.T.ravel().tolist()):
        numbers[k] = x
    linalg = jvm.org.apache.spark.ml.linalg
    shares = df.sparkSession.sparkContext._gateway.new_array(jvm.double, v.shape[1])
    model = jvm.org.apache.spark.ml.feature.PCAModel("projection", linalg.DenseMatrix(v.shape[0], v.shape[1], numbers), linalg.DenseVector(shares))
    out = PCAModel(model)._set(k=v.shape[1]).setInputCol(features_col).setOutputCol("_scores").transform(df.select(id_col, features_col))
    return out.select(id_col, vector_to_array("_scores").alias("scores"))


def to_vector(array: Column) -> Column:
    return array_to_vector(array.cast("array<double>"))

