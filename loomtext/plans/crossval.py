"""Cross-validation of a cleaned corpus: folds once, features by method, metrics as one document."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.tokens import STOP_WORDS, ngram_range, tokens
from loomtext.operators import corpus as c
from loomtext.operators import features as f
from loomtext.operators import model as m
from loomtext.operators.sampling import stratified_folds
from loomtext.plans.config import names, require, section, train_balance
from loomtext.plans.text_corpus import cleaned_view
from loomtext.session import durable
from loomtext.sources.files import file_exists
from loomtext.sources.readers import folds as read_folds
from loomtext.sources.readers import json_lines, word_vectors
from loomtext.sources.writers import check_folds, write_document, write_folds

#: Fixed value: the methods, in their default order. The encoders among them are injected.
METHODS = ("tfidf", "bert", "glove", "gemma", "linq")
Encoders = Mapping[str, Callable]
log = logging.getLogger(__name__)


def vectoriser_options(config: Mapping) -> dict:
    """Of the sections vectorizer and transformer; what isn't known or can't be done is an error, never passed over."""
    count, weigh = section(config, "vectorizer"), config.get("transformer") or {}
    known = {"analyzer", "ngram_range", "lowercase", "max_features", "stop_words", "min_df", "max_df"}
    if unknown := sorted({*count} - known | {*weigh} - {"use_idf", "smooth_idf", "norm", "sublinear_tf"}):
        raise ValueError(f"unknown options of the vectoriser: {unknown}")
    least, most = ngram_range(count.get("ngram_range", (2, 4)))
    stop = count.get("stop_words")
    if isinstance(stop, str):
        raise ValueError("stop_words must be a list of words or null")
    flags = {"lowercase": (count, False), "use_idf": (weigh, True), "smooth_idf": (weigh, True), "sublinear_tf": (weigh, False)}
    options = {name: own.get(name, usual) for name, (own, usual) in flags.items()}
    if bad := [name for name, value in options.items() if not isinstance(value, bool)]:
        raise ValueError(f"must be true or false: {bad}")
    numbers = {name: count.get(name, usual) for name, usual in (("min_df", 1), ("max_df", 1.0))}
    top = count.get("max_features")
    return options | numbers | {"least": least, "most": most, "max_features": int(top) if top else None, "analyzer": count.get("analyzer", "char"), "stop_words": stop, "norm": weigh.get("norm", "l2")}


def encoder_options(config: Mapping, method: str) -> dict:
    """Pooling, batch size (the method's own, then the plan's for it, then the plan's) and sequence length."""
    own, cv = section(config, method), config.get("crossval") or {}
    batch = own.get("batch_size") or cv.get(f"{method}_batch_size") or cv.get("batch_size") or 8
    length = own.get("max_seq_length")
    return {"pooling": own.get("embedding_strategy") or own.get("pooling", "mean"), "last": int(own.get("last_n_layers", 4)), "batch": int(batch), "max_length": int(length) if length else None}


def logistic_options(config: Mapping | None) -> dict:
    own = config or {}
    weight = own.get("class_weight", "balanced")
    if weight not in ("balanced", None):
        raise ValueError(f"unknown class weight: {weight}")
    return {"c": float(own.get("C", 1.0)), "max_iter": int(own.get("max_iter", 1000)), "balanced": weight == "balanced", "solver": own.get("solver", "lbfgs")}


def method_features(spark: SparkSession, rows: DataFrame, method: str, config: Mapping, encoders: Encoders) -> DataFrame:
    """Features of all rows for the methods whose features don't depend on the fold."""
    own = section(config, method)
    if method == "tfidf":
        options = vectoriser_options(own)
        return f.fit_tfidf(rows, "text", **options).transform(rows, "text")
    if method == "glove":
        if own.get("pooling", "sum_l2norm") != "sum_l2norm":
            raise ValueError("only sum_l2norm pooling is supported")
        how = own.get("tokenizer", "whitespace")
        if how == "jieba":
            how = encoders["jieba"]
        stop = STOP_WORDS if own.get("remove_stopwords") and str(own.get("stopwords_lang")).lower() == "english" else None
        dim = int(require(own, "embedding_dim", "glove."))
        vectors = word_vectors(spark, require(own, "embeddings_path", "glove."), dim, own.get("max_words"))
        words = tokens(F.col("text"), how, lowercase=bool(own.get("lowercase")), stop_words=stop)
        pooled = f.pooled_vectors(rows, vectors, id_col="row_id", words=words, dim=dim)
        return rows.join(pooled, "row_id").withColumn("features", f.to_vector(F.col("vector"))).drop("vector")
    if method not in encoders:
        raise ValueError(f"no encoder was given for {method}")
    encoded = f.encode_texts(rows, "text", encoders[method], **encoder_options(config, method))
    return encoded.withColumn("features", f.to_vector(F.col("embedding"))).drop("embedding")


def run_crossval(spark: SparkSession, config: Mapping, *, methods: list[str] | None = None, reuse_folds: bool = False, encoders: Encoders | None = None) -> str:
    """Every chosen method over the same folds; writes the metrics document and returns its path."""
    features = section(config, "features")
    cv = section(features, "crossval")
    if not cv.get("enabled", True):
        return ""
    chosen = methods or names(cv.get("methods")) or list(METHODS)
    if unknown := [x for x in chosen if x not in METHODS]:
        raise ValueError(f"unknown methods: {unknown}")
    n_splits, place = int(require(cv, "n_splits", "crossval.")), require(cv, "output_indices", "crossval.")
    source = require(section(config, "text"), "cleaned_jsonl", "text.")
    rows = durable(cleaned_view(json_lines(spark, source, ordered=True)))
    c.assert_class_sizes(rows, "y", n_splits)
    reused = reuse_folds and file_exists(place)
    if reused:
        saved = read_folds(spark, place)
        check_folds(saved, rows)
        folded = rows.join(saved.filter("is_test").select("row_id", "fold"), "row_id")
    else:
        seed = int(require(cv, "random_state", "crossval.")) if cv.get("shuffle", True) else None
        folded = stratified_folds(rows, n_splits=n_splits, seed=seed, keys=["row_id"], label_col="y")
    folded = durable(folded)
    if not reused:
        write_folds(folded, place, n_splits=n_splits)
    balance = train_balance(cv.get("train_balance"))
    average, zero = cv.get("metrics_average", "macro"), float(cv.get("zero_division", 0))
    document: dict = {
        "data": {"cleaned_jsonl": source, "n_samples": folded.count(), "label_counts": _named(m.label_counts(folded, []).first())},
        "crossval": {"n_splits": n_splits, "train_balance": balance, "metrics_average": average},
        "methods": {},
    }
    records = {r["fold"]: _record(r) for r in m.fold_records(folded, balance["balance"]).collect()}
    for method in chosen:
        own = section(features, method)
        logistic = logistic_options(own.get("logreg"))
        scope = cv.get("tfidf_fit_scope", "full")
        if method == "tfidf" and scope == "train":
            found = m.cross_validate_tfidf(folded, n_splits, text_col="text", keys=["row_id"], vectoriser=vectoriser_options(own), **balance, **logistic)
        else:
            ready = method_features(spark, folded, method, features, encoders or {})
            found = m.cross_validate(ready, n_splits, keys=["row_id"], **balance, **logistic)
        table = durable(m.confusion(found))
        by_fold = m.metrics(table, average=average, zero=zero).orderBy("fold")
        matrices = table.orderBy("fold").collect()
        document["methods"][method] = {
            "method": method,
            "fold_metrics": [r.asDict() | records[r["fold"]] for r in by_fold.collect()],
            "summary": m.summary(by_fold).first().asDict(),
            "confusion_matrices": [[[r.n00, r.n01], [r.n10, r.n11]] for r in matrices] if cv.get("print_confusion_matrix", True) else [],
            "train_balance": balance,
        } | ({"tfidf_fit_scope": scope} if method == "tfidf" else {})
        if cv.get("print_report", False):
            for r in m.classification_report(table).orderBy("fold").collect():
                log.info("fold %s (%s): %s precision %.4f recall %.4f f1 %.4f support %s", r["fold"], method, r["class"], r["precision"], r["recall"], r["f1"], r["support"])
    target = require(cv, "metrics_output", "crossval.")
    write_document(document, target)
    return target


def _record(row) -> dict:
    counts = {f"{part}_label_counts": {name: row[f"{part}_{name}"] for name in ("HC", "AD")} for part in ("train", "test")}
    return {name: row[name] for name in ("n_train", "n_train_before_balance", "n_test")} | counts


def _named(row) -> dict:
    return {"HC": row["HC"], "AD": row["AD"]}
