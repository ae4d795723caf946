"""Findings in words: pluggable reasoners, prompts, and promotion of conclusions to labels."""

from __future__ import annotations

import json
import urllib.request
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "**Conclusion:**"
SLICE_ROWS = 20_000


class Reasoner(Protocol):
    def answer(self, prompt: str) -> str: ...


class OfflineReasoner:
    """Says the same for the same prompt, without any network."""

    def answer(self, prompt: str) -> str:
        first = prompt.strip().split("\n", 1)[0]
        return for_report(f"{len(prompt.split())} words were weighed.", f"{first}.")


class HttpReasoner:
    """A chat-completions endpoint."""

    def __init__(self, url: str, key: str, model: str, timeout: float = 300):
        self.url, self.key, self.model, self.timeout = url.rstrip("/"), key, model, timeout

    def answer(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(f"{self.url}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            message = json.load(reply)["choices"][0]["message"]
        return for_report(message.get("reasoning_content") or "", message["content"])


def for_report(thought: str, answer: str) -> str:
    """Thought and answer as one chain; the answer alone without a thought."""
    return f"**Thinking:** {thought}\n\n{MARK} {answer}" if thought else answer


def reasoned(prompts: DataFrame, reasoner: Reasoner, parallel: int = 4) -> DataFrame:
    """Prompts with ``reasoning_chain``; a prompt whose call fails is left out."""
    schema = ", ".join(f"{n} {t}" for n, t in prompts.dtypes) + ", reasoning_chain string"

    def run(batches):
        for pdf in batches:
            chains = []
            for p in pdf["prompt"]:
                try:
                    chains.append(reasoner.answer(p))
                except Exception:
                    chains.append(None)
            out = pdf.assign(reasoning_chain=pd.Series(chains, index=pdf.index, dtype=object))
            yield out[out["reasoning_chain"].notna()]

    return prompts.repartition(parallel).mapInPandas(run, schema)


def snippets(members: DataFrame, most: int = 8, width: int = 200, cluster: str = "cluster_id") -> DataFrame:
    """``(cluster, snippets)``: texts spread over each cluster, then in order, distinct after cutting."""
    text = members.where("fragment is not null and fragment not in ('', 'N/A')").withColumn("seq", F.coalesce("seq", F.lit(-1)))
    every = Window.partitionBy(cluster)
    # places are counted by slices of seq, so that no task orders a whole cluster
    sizes = text.groupBy(cluster).agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    text = text.join(sizes, cluster).withColumn("slice", F.floor((F.col("seq") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.ceil(F.col("n") / SLICE_ROWS)))
    before = text.groupBy(cluster, "slice").agg(F.count("*").alias("k"))
    before = before.select(cluster, "slice", F.coalesce(F.sum("k").over(every.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(cluster, "slice").orderBy("seq", "id"))
    at = text.join(before, [cluster, "slice"]).withColumn("pos", F.col("base") + inside - 1).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / 24)))
    short = F.when(F.length("fragment") > width, F.concat(F.left("fragment", F.lit(width)), F.lit("..."))).otherwise(F.col("fragment"))
    at = at.select(cluster, short.alias("t"), (F.col("pos") % F.col("step") != 0).alias("later"), "pos")
    best = at.groupBy(cluster, "t").agg(F.min(F.struct("later", "pos")).alias("o"))
    ranked = best.withColumn("r", F.row_number().over(every.orderBy("o"))).where(F.col("r") <= most)
    return ranked.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("snippets"))


def _shown(c: str, pattern: str) -> Column:
    return F.when(F.col(c).isNull(), "unknown").otherwise(F.format_string(pattern, c))


def first_texts(members: DataFrame, most: int = 8, cluster: str = "cluster_id") -> DataFrame:
    """``(cluster, texts)``: the first texts of each cluster in order of ``seq``, repeats among them."""
    text = members.where("fragment is not null and fragment not in ('', 'N/A')")
    ranked = text.withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy("seq", "id"))).where(F.col("r") <= most)
    return ranked.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "fragment"))), lambda x: x["fragment"]).alias("texts"))


def label_prompts(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """``(cluster_id, prompt)`` that asks for a short name; clusters without texts have none."""
    head = F.format_string("Name what these texts of %s points share (coherence %s), in three to six words and nothing else.", _shown("size", "%d"), _shown("coherence", "%.2f"))
    return clusters.join(first_texts(members), "cluster_id").select("cluster_id", F.concat_ws("\n---\n", head, F.array_join("texts", "\n---\n")).alias("prompt"))


def named(clusters: DataFrame, members: DataFrame, reasoner: Reasoner) -> DataFrame:
    """Clusters with the first line of the answer as label, without quotes; the old label stays where there is no answer."""
    told = reasoned(label_prompts(clusters, members), reasoner)
    plain = F.regexp_replace(F.trim("reasoning_chain"), "^[\"'`]+|[\"'`]+$", "")
    new = told.select("cluster_id", F.trim(F.substring_index(plain, "\n", 1)).alias("__new"))
    return clusters.join(new, "cluster_id", "left").withColumn("label", F.coalesce(F.nullif("__new", F.lit("")), "label")).drop("__new")


def cluster_prompts(clusters: DataFrame, snippet: DataFrame) -> DataFrame:
    head = F.format_string("Cluster %d: %s (size %s, coherence %s, density %s)", "cluster_id", "label", _shown("size", "%d"), _shown("coherence", "%.2f"), _shown("density", "%.2f"))
    return clusters.join(snippet, "cluster_id", "left").select("cluster_id", F.concat_ws("\n- ", head, F.array_join("snippets", "\n- ")).alias("prompt"))


def bridge_texts(bridges: DataFrame, members: DataFrame) -> DataFrame:
    """``(cluster_a, cluster_b, texts_a, texts_b)``: the distinct texts at the ends of each bridge's sample links, in their order."""
    links = bridges.select("cluster_a", "cluster_b", F.posexplode("sample_links").alias("pos", "link"))
    texts = members.where("fragment is not null and fragment not in ('', 'N/A')").select("id", "fragment").dropDuplicates(["id"])
    out = bridges.select("cluster_a", "cluster_b")
    for x in "ab":
        end = links.select("cluster_a", "cluster_b", "pos", F.col(f"link.chunk_{x}_id").alias("id")).join(texts, "id")
        first = end.groupBy("cluster_a", "cluster_b", "fragment").agg(F.min("pos").alias("pos"))
        packed = first.groupBy("cluster_a", "cluster_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "fragment"))), lambda t: t["fragment"]).alias(f"texts_{x}"))
        out = out.join(packed, ["cluster_a", "cluster_b"], "left")  # as many texts as a bridge has links
    return out


def bridge_prompts(bridges: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Prompts about bridges; with ``texts`` of their ends."""
    if texts is not None:
        sides = [F.when(F.size(f"texts_{x}") > 0, F.concat(F.format_string("Cluster %d:\n- ", f"cluster_{x}"), F.array_join(f"texts_{x}", "\n- "))) for x in "ab"]
        plain = bridge_prompts(bridges).join(texts, ["cluster_a", "cluster_b"], "left")
        return plain.select("cluster_a", "cluster_b", F.concat_ws("\n", "prompt", *sides).alias("prompt"))
    return bridges.select("cluster_a", "cluster_b", F.format_string("Bridge: %d ↔ %d, strength %.2f (%s)", "cluster_a", "cluster_b", "strength", "link_type").alias("prompt"))


def moat_prompts(moats: DataFrame) -> DataFrame:
    return moats.select("cluster_a", "cluster_b", F.format_string("Moat: %d ↔ %d, distance %.2f", "cluster_a", "cluster_b", "distance").alias("prompt"))


def conclusion(chain: str | Column) -> Column:
    """First sentence after the last conclusion mark, without markdown, at most 80 characters."""
    c = F.col(chain) if isinstance(chain, str) else chain
    tail = F.trim(F.regexp_replace(F.substring_index(c, MARK, -1), r"^\s+|\s+$", ""))
    sentence = F.regexp_extract(tail, r"^[^.!?]*[.!?]", 0)
    plain = F.trim(F.regexp_replace(F.when(sentence == "", tail).otherwise(sentence), r"[*_`]", ""))
    return F.when(F.length(plain) > 80, F.concat(F.left(plain, F.lit(77)), F.lit("..."))).otherwise(plain)


FINDINGS = "type string, subject string, reasoning_chain string, confidence double, is_anomaly boolean, requires_review boolean, clusters array<int>"


def findings(clusters: DataFrame, bridges: DataFrame, moats: DataFrame, members: DataFrame, reasoner: Reasoner, confidence: float = 0.75, low_coherence: float = 0.5, top_bridges: int = 10, top_moats: int = 5) -> DataFrame:
    """Findings about every cluster, the strongest bridges and the widest moats, one answer each; a failed call leaves its finding out.

    A cluster of low coherence is an anomaly, and so is every moat.
    """
    order = lambda df, by, most: df.orderBy(F.desc(by), "cluster_a", "cluster_b").limit(most)
    bridge, moat = order(bridges, "strength", top_bridges), order(moats, "distance", top_moats)
    prompts = bridge_prompts(bridge, bridge_texts(bridge, members)) if "sample_links" in bridges.columns else bridge_prompts(bridge)
    about = lambda df, told: reasoned(told, reasoner).join(df, told.columns[:-1])
    ids = lambda *c: F.array(*[F.col(x).cast("int") for x in c])

    def row(df, kind, subject, anomaly, ends):
        return df.select(F.lit(kind).alias("type"), subject.alias("subject"), "reasoning_chain", F.lit(confidence).alias("confidence"), F.coalesce(anomaly, F.lit(False)).alias("is_anomaly"), F.lit(False).alias("requires_review"), ends.alias("clusters"))

    parts = [
        row(about(clusters, cluster_prompts(clusters, snippets(members))), "cluster_analysis", F.format_string("Cluster %d: %s", "cluster_id", "label"), F.col("coherence") < low_coherence, ids("cluster_id")),
        row(about(bridge, prompts), "bridge_analysis", F.format_string("Bridge: %d ↔ %d", "cluster_a", "cluster_b"), F.lit(False), ids("cluster_a", "cluster_b")),
        row(about(moat, moat_prompts(moat)), "moat_analysis", F.format_string("Moat: %d ⊥ %d", "cluster_a", "cluster_b"), F.lit(True), F.array().cast("array<int>")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def promote_clusters(clusters: DataFrame, findings: DataFrame) -> DataFrame:
    """Clusters labelled with their finding's conclusion; the old label becomes the source."""
    new = findings.select("cluster_id", conclusion("reasoning_chain").alias("__new")).where("__new <> ''").groupBy("cluster_id").agg(F.min("__new").alias("__new"))
    joined = clusters.join(new, "cluster_id", "left")
    return joined.withColumns({"source": F.when(F.col("__new").isNotNull(), F.col("label")).otherwise(F.col("source")), "label": F.coalesce("__new", "label")}).drop("__new")


def promote_bridges(bridges: DataFrame, findings: DataFrame) -> DataFrame:
    """Bridges labelled with the conclusion for their pair, whichever way round."""
    new = findings.select(F.least("cluster_a", "cluster_b").alias("__lo"), F.greatest("cluster_a", "cluster_b").alias("__hi"), conclusion("reasoning_chain").alias("__new")).where("__new <> ''").groupBy("__lo", "__hi").agg(F.min("__new").alias("__new"))
    joined = bridges.join(new, (F.least("cluster_a", "cluster_b") == F.col("__lo")) & (F.greatest("cluster_a", "cluster_b") == F.col("__hi")), "left")
    return joined.withColumn("label", F.coalesce("__new", "label")).drop("__lo", "__hi", "__new")
