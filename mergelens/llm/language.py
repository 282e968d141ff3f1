"""Language ID by fusing evidence as Bayes' rule does.

log P(l | page) = text likelihood + log P(declared | l) + log P(l | host), each term on log scale:

* text: hashed byte n-grams (one to three bytes of the lower-cased text), one smoothed multinomial for each language, over
  the whole text; the mean log probability counts as that of at most `weight` n-grams, since n-grams overlap;
* declared: how often each declared markup language stands with each language, from grouped sums of the text's
  own posteriors, smoothed;
* host: posterior sums by host, smoothed towards its address suffix, which is smoothed towards all rows. A row's own
  text is taken out of its host's sums and of its declaration's, so that no evidence counts twice.

The n-gram model is fitted on about `sample` whole texts of each label, whatever their number (a bounded fit on labels, four times as many at
most); every other figure covers all rows. Rows keep their place: null and empty texts have even text
evidence, null hosts and declared languages are groups of their own. A row is accepted if its text has letters
and its best language has `least` of the posterior; ties go to the first language in alphabetical order. Without any
label, no language is known and rows with letters are accepted. Equal rows get equal results. Other columns of pages or documents are
not read, so their names cannot clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.operators.stats import per_group_cap

from .common import flat_bytes, mapped, read, slices, table, widen

BITS = 13
CLOSING = {name: re.compile(rf"</{name}\s*>") for name in ("script", "style")}
OPENING = re.compile(r"<(script|style)\b")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
LETTER = re.compile(r"[^\W\d_]")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of all texts, position by position (three arrays in one), and where the texts begin."""
    flat, starts = flat_bytes([t.lower().encode() for t in texts])
    n = len(flat)
    x = np.zeros(n + 2, np.uint32)
    x[:n] = flat
    one, two, three = x[:n], x[1 : n + 1], x[2 : n + 2]
    slots = np.empty((3, n), np.int32)
    slots[0] = one
    for i, code in ((1, one | two << np.uint32(8)), (2, one | two << np.uint32(8) | three << np.uint32(16))):
        slots[i] = (((code + np.uint32(i)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)) + (256 if i == 1 else 256 + (1 << BITS))
    ends = starts[1:][np.diff(starts) > 0] - 1
    slots[1, ends] = slots[2, ends] = 256 + (2 << BITS)  # a slot that counts for nothing
    before = ends[ends > 0] - 1
    slots[2, before] = 256 + (2 << BITS)
    return slots, starts


class TextModel:
    def __init__(self, languages: list[str], logs: np.ndarray, weight: float):
        self.languages, self.logs, self.weight = languages, logs, weight

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """One row for each text, one column for each language; even for texts without n-grams."""
        out = np.zeros((len(texts), len(self.languages)))
        slots, starts = grams(texts)
        full = np.flatnonzero(np.diff(starts) > 0)
        if not len(full) or not self.languages:
            return out
        n = np.diff(starts)[full]
        for k in range(len(self.languages)):
            mine = self.logs[:, k]
            total = sum(np.add.reduceat(mine[s], starts[full], dtype=np.float64) for s in slots)
            out[full, k] = total / (3 * n) * np.minimum(n, self.weight)
        return out


def fit(docs: DataFrame, sample: int = 300, weight: float = 60.0, text: str = "text", label: str = "lang", key: str = "doc_id") -> TextModel:
    """N-grams of about `sample` rows of each label, four times as many at most, every text whole."""
    labelled = docs.withColumn("l", F.lower(F.trim(label))).where("l <> ''")
    counts = table(labelled.groupBy("l").agg(F.count("*").alias("n")), "labels")
    languages = sorted(r["l"] for r in counts.collect())
    if not languages:
        return TextModel([], np.zeros((256 + (2 << BITS) + 1, 0), np.float32), weight)
    draw = F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1 << 30))
    rows = labelled.where(F.col(text).isNotNull()).select("l", draw.alias("draw"), F.col(text).alias("t")).join(F.broadcast(counts), "l")
    rows = per_group_cap(rows.where(F.col("draw") <= F.least(F.lit(1.0), sample / F.col("n")) * (1 << 30)), "l", 4 * sample, "draw", "t").select("l", "t").collect()
    size = 256 + (2 << BITS) + 1
    seen = np.zeros((size, len(languages)))
    for k, language in enumerate(languages):
        slots, _ = grams([r["t"] for r in rows if r["l"] == language])
        seen[:, k] = np.bincount(slots.ravel(), minlength=size)[:size]
    seen[-1] = 0
    parts = [slice(0, 256), slice(256, 256 + (1 << BITS)), slice(256 + (1 << BITS), size - 1)]
    logs = np.zeros((size, len(languages)), np.float32)
    for p in parts:
        logs[p] = np.log((seen[p] + 0.05) / (seen[p].sum(axis=0) + 0.05 * len(seen[p])))
    return TextModel(languages, logs, weight)


def strip_markup(html: str) -> str:
    """A blank for each tag, comment, script and style; once an ending is not found it is not looked for again, so time is linear."""
    low, out, at, missing = html.translate(ASCII_LOWER), [], 0, set()
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        end = -1
        if (m := OPENING.match(low, i)) and m[1] not in missing:
            close = CLOSING[m[1]].search(low, m.end())
            end = close.end() if close else -1
            if not close:
                missing.add(m[1])
        elif html.startswith("<!--", i) and "-->" not in missing:
            end = html.find("-->", i + 4) + 3
            if end < 3:
                end = -1
                missing.add("-->")
        if end < 0:
            end = html.find(">", i + 1) + 1
            if not end:
                return "".join([*out, html[i:]])
        out.append(" ")
        at = end
    return "".join([*out, html[at:]])


def score_text(rows: DataFrame, model: TextModel, text: str, markup: bool) -> DataFrame:
    """rows without the text, with its log likelihoods by language and whether it has letters."""
    at, names = rows.columns.index(text), [c for c in rows.columns if c != text]
    schema = widen(rows.drop(text), likelihoods="array<double>", letters="boolean")

    def run(batches):
        for batch in slices(batches, at):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if markup:
                texts = [strip_markup(t) for t in texts]
            found = model.likelihoods(texts)
            letters = [LETTER.search(t) is not None for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(letters)], names=[*names, "likelihoods", "letters"])

    return rows.transform(mapped, run, schema)


def fuse(scored: DataFrame, model: TextModel, least: float = 0.5, by_suffix: float = 20.0, by_host: float = 10.0, by_declared: float = 1.0) -> DataFrame:
    """scored (host, suffix, declared, likelihoods, letters, and more) with text_language, language, posterior, accepted."""
    k = len(model.languages)
    if not k:
        nothing = F.lit(None).cast("string")
        return scored.select(*[c for c in scored.columns if c not in ("likelihoods", "letters")], nothing.alias("text_language"), nothing.alias("language"), F.lit(None).cast("double").alias("posterior"), F.col("letters").alias("accepted"))
    names = F.array(*map(F.lit, model.languages))
    top = F.array_max("likelihoods")
    soft = F.transform("likelihoods", lambda x: F.exp(x - top))
    rows = scored.withColumn("soft", soft).withColumn("own", F.transform("soft", lambda x: x / F.aggregate("soft", F.lit(0.0), lambda a, b: a + b))).drop("soft")
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "suffix": F.coalesce("suffix", F.lit("")), "declared": F.coalesce("declared", F.lit(""))})
    sums = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(k)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    pack = lambda p: F.array(*[F.col(f"{p}{i}") for i in range(k)])
    hosts = rows.groupBy("host", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*again)
    whole = suffixes.agg(*again)
    everywhere = [max(float(x or 0), 0.0) + 1.0 for x in whole.first()]
    total = sum(everywhere)
    prior = [x / total for x in everywhere]
    n_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    base = F.array(*map(F.lit, prior))
    suffixes = suffixes.select("suffix", pack("s").alias("sums")).select("suffix", F.transform(F.arrays_zip(F.col("sums").alias("a"), base.alias("b")), lambda x: (x["a"] + by_suffix * x["b"]) / (n_of(F.col("sums")) + by_suffix)).alias("suffix_share"))
    hosts = hosts.select("host", "suffix", pack("s").alias("host_sums")).join(suffixes, "suffix")
    declared = table(rows.groupBy("declared").agg(*sums).select("declared", pack("s").alias("declared_sums")), "declared", narrow=True)
    kinds = float(declared.count() + 1)
    full = join_known(join_known(rows, table(hosts, "hosts", narrow=True), ["host", "suffix"]), declared, ["declared"])
    zipped = F.arrays_zip(F.col("likelihoods").alias("t"), F.col("own").alias("o"), F.col("host_sums").alias("h"), F.col("suffix_share").alias("s"), F.col("declared_sums").alias("d"), F.array(*map(F.lit, everywhere)).alias("e"))
    others = F.greatest(n_of(F.col("host_sums")) - 1.0, F.lit(0.0))
    said = lambda x: F.log((F.greatest(x["d"] - x["o"], F.lit(0.0)) + by_declared) / (x["e"] - x["o"] + by_declared * kinds))  # noqa: E731  without the row itself
    logs = F.transform(zipped, lambda x: x["t"] + F.when(F.col("declared") == "", F.lit(0.0)).otherwise(said(x)) + F.log((F.greatest(x["h"] - x["o"], F.lit(0.0)) + by_host * x["s"]) / (others + by_host)))
    full = full.withColumn("logs", logs).withColumn("best", F.array_max("logs"))
    posterior = 1.0 / n_of(F.transform("logs", lambda x: F.exp(x - F.col("best"))))
    pick = lambda c, m: names[F.array_position(c, m).cast("int") - 1]
    keep = [c for c in scored.columns if c not in ("likelihoods", "letters", "host", "suffix", "declared")]
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return full.select(
        *keep, blank("host"), blank("suffix"), blank("declared"),
        F.when(F.array_max("likelihoods") > F.array_min("likelihoods"), pick(F.col("likelihoods"), F.array_max("likelihoods"))).alias("text_language"),
        pick(F.col("logs"), F.col("best")).alias("language"), posterior.alias("posterior"), (F.col("letters") & (posterior >= least)).alias("accepted"),
    )


def join_known(rows: DataFrame, known: DataFrame, keys: list[str], most: int = 100_000, salts: int = 32) -> DataFrame:
    """rows with what is known of their keys, one row for each. Up to `most` are broadcast (some hundred bytes each); more are joined with salts, each
    being sent once for each, so that a key with a third of all rows meets them in many tasks."""
    if known.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(known), keys)
    salted = rows.withColumn("_salt", F.floor(F.rand(1) * salts).cast("int"))
    return salted.join(known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"]).drop("_salt")


def host_of(url):
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(host):
    return F.nullif(F.regexp_extract(host, r"([^.]+)\.?$", 1), F.lit(""))


def declared_of(html):
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)), F.lit(""))


def identify_pages(pages: DataFrame, docs: DataFrame, sample: int = 300, **options) -> DataFrame:
    """page_id, host, suffix, declared, text_language, language, posterior, accepted of each page; docs (doc_id, text, lang) teach the text model."""
    model = fit(docs, sample)
    rows = pages.select("page_id", host_of("url").alias("host"), declared_of("html").alias("declared"), F.col("html").cast("string").alias("html")).withColumn("suffix", suffix_of(F.col("host")))
    return fuse(table(score_text(rows, model, "html", True), "page-scores", narrow=True), model, **options)


def identify_documents(docs: DataFrame, sample: int = 300, **options) -> DataFrame:
    """doc_id and findings of each document: its lang is the declared language, its source the host."""
    model = fit(docs, sample)
    rows = docs.select("doc_id", F.col("source").alias("host"), F.lower(F.trim("lang")).alias("declared"), F.lit("").alias("suffix"), F.col("text").cast("string").alias("text"))
    return fuse(table(score_text(rows, model, "text", False), "document-scores", narrow=True), model, **options)


def op10_language(spark, sf_dir: str) -> DataFrame:
    return identify_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
