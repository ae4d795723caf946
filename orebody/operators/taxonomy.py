"""Topic, mode and epistemic posture of texts by weighted phrases; label repair; taxonomy queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.vocabulary import DEFAULT, LABEL_KEYWORDS

THRESHOLDS = {"mode": (1.0, "unknown"), "posture": (1.0, "unknown"), "topic": (2.0, "general")}


MODES, POSTURES = (*DEFAULT["mode"], "unknown"), (*DEFAULT["posture"], "unknown")
ANOMALIES = ("label_mismatch", "source_oversampling", "summary_template_artifact", "mode_drift", "embedding_bias_suspected")


def _axis(texts: list[str], axis: dict[str, list[tuple[str, float]]], least: float, neutral: str) -> tuple[np.ndarray, np.ndarray]:
    """The best candidate of each text and its lead. A phrase counts once a text; ties go to the smaller name."""
    names = sorted(axis)
    scores = np.zeros((len(texts), max(len(names), 2)))
    for c, name in enumerate(names):
        for phrase, weight in axis[name]:
            scores[:, c] += weight * np.fromiter((phrase in t for t in texts), bool, len(texts))
    best, top = scores.argmax(axis=1), np.sort(scores, axis=1)[:, ::-1]
    ok = (top[:, 0] >= least) & bool(names)
    lead = np.where(ok, (top[:, 0] - top[:, 1]) / (top[:, 0] + 1e-9), 0.0)
    return np.where(ok, np.array([*names, neutral], dtype=object)[np.minimum(best, len(names))], neutral), lead


def classify(df: DataFrame, text: str, vocabulary: dict | None = None) -> DataFrame:
    """Add ``topic``, ``mode``, ``posture`` and ``confidence``, in one pass over Arrow batches of lower-cased texts.

    An axis whose best score is below its threshold gets the neutral value and confidence 0; else its
    confidence is the lead over the second as a share of the best. Empty and null texts are neutral.
    """
    vocabulary = vocabulary or DEFAULT

    @F.pandas_udf("struct<topic:string,mode:string,posture:string,confidence:double>")
    def judged(column: pd.Series) -> pd.DataFrame:
        texts, out, confidence = column.tolist(), {}, 0.0
        for axis in ("topic", "mode", "posture"):
            out[axis], lead = _axis(texts, vocabulary[axis], *THRESHOLDS[axis])
            confidence = confidence + lead
        return pd.DataFrame(out | {"confidence": confidence / 3})

    name = "__judged"
    while name in df.columns:
        name += "_"
    found = df.withColumn(name, judged(F.lower(F.coalesce(F.col(text), F.lit("")))))
    return found.withColumns({c: F.col(name)[c] for c in ("topic", "mode", "posture", "confidence")}).drop(name)


def source_family(label: str | Column) -> Column:
    """The text after the first " / " of a label, trimmed; without one the label."""
    c = F.col(label) if isinstance(label, str) else label
    at = F.instr(c, " / ")
    return F.when(at > 0, F.trim(F.substr(c, at + 3))).otherwise(c)


def _has_any(label: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(label, F.lit(w)) for w in words), F.lit(False))


def label_names_topic(label: Column, topic: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The label has the topic's first word or one of its keywords."""
    keywords = keywords or LABEL_KEYWORDS
    own = reduce(lambda a, b: a | b, ((topic == t) & _has_any(label, w) for t, w in keywords.items()), F.lit(False))
    return F.contains(label, F.split(topic, "_")[0]) | own


def label_warning(label: str, topic: str = "topic", mode: str = "mode", keywords: dict[str, list[str]] | None = None) -> Column:
    """Why a label contradicts the classification of its content; empty if it doesn't.

    A didactic label needs the teaching mode (or none). A label that doesn't name the topic found, but
    has a word of another, contradicts it; topics are tried by name.
    """
    keywords = keywords or LABEL_KEYWORDS
    lower, topic_, mode_ = F.lower(F.coalesce(F.col(label), F.lit(""))), F.col(topic), F.col(mode)
    foreign = F.coalesce(*[F.when((topic_ != t) & F.contains(lower, F.lit(w)), w) for t in sorted(keywords) for w in keywords[t]])
    return (
        F.when(F.contains(lower, F.lit("didactic")) & ~mode_.isin("didactic_teaching", "unknown"), F.concat(F.lit("didactic label over content in mode "), mode_))
        .when(topic_.isNull() | topic_.isin("", "general") | label_names_topic(lower, topic_, keywords), "")
        .when(foreign.isNotNull(), F.concat(F.lit("label says "), foreign, F.lit(", content is "), topic_))
        .otherwise("")
    )


def first_fragments(members: DataFrame, most: int = 12, width: int = 300, cluster: str = "cluster_id") -> DataFrame:
    """``(cluster, fragments)``: the first distinct fragments of each cluster in order of ``seq``, each cut to ``width`` characters."""
    real = members.where("fragment is not null and fragment not in ('', 'N/A')").groupBy(cluster, "fragment").agg(F.min("seq").alias("seq"))
    ranked = real.withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy("seq", "fragment"))).where(F.col("r") <= most)
    packed = F.sort_array(F.collect_list(F.struct("r", F.left("fragment", F.lit(width)).alias("f"))))  # at most ``most`` a cluster
    return ranked.groupBy(cluster).agg(F.transform(packed, lambda x: x["f"]).alias("fragments"))


def classify_clusters(clusters: DataFrame, members: DataFrame, vocabulary: dict | None = None) -> DataFrame:
    """Clusters with a ``taxonomy`` struct made from their members' fragments."""
    texts = first_fragments(members).select("cluster_id", F.array_join("fragments", " ").alias("__text"))
    done = classify(clusters.drop("taxonomy").join(texts, "cluster_id", "left"), "__text", vocabulary)
    taxonomy = F.struct(
        "topic", "mode", F.col("posture").alias("epistemic_posture"), source_family("label").alias("source_family"), "confidence", label_warning("label").alias("label_warning"), F.lit("").alias("semantic_concept")
    )
    return done.withColumn("taxonomy", taxonomy).drop("__text", "topic", "mode", "posture", "confidence")


def matches(topic: str = "", mode: str = "", posture: str = "", mismatch: bool = False) -> Column:
    """Predicate over ``taxonomy``: all given criteria hold, whatever the case; without taxonomy only the empty query matches."""
    wanted = [F.lower(f"taxonomy.{f}") == v.lower() for f, v in (("topic", topic), ("mode", mode), ("epistemic_posture", posture)) if v]
    if mismatch:
        wanted.append(F.coalesce(F.col("taxonomy.label_warning"), F.lit("")) != "")
    return F.coalesce(reduce(lambda a, b: a & b, wanted, F.lit(True)), F.lit(False))
