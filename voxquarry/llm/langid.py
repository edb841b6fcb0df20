"""Language identification by compression.

For each learned language a raw-content zstandard dictionary is cut from a
bounded sample of labelled texts.  A text is encoded once per language, in
segments, and the language whose dictionary gives the fewest bytes wins; the score
grows with the margin to the runner-up.  Texts are compared in lower case.

Three measures, each a share of the winner's bytes, mark a document as rejected:
a narrow margin to the runner-up, little gained on a coder without a dictionary
(text in no learned language), and much to gain by other languages in single
segments (text in several).  Their limits are those that ``FALSE_REJECTIONS`` of
the labelled training documents fail, each measured with dictionaries that don't
hold the document.

Every segment is compressed on its own, so that each part of a long text leans on
the dictionary and not on the text before it; all of the text counts.

Bounds of the model (documented parameters): the ``LANGS`` languages with the most
labelled documents (ties: the alphabetically first), ``DICT_BYTES`` of each, from
``SAMPLE_DOCS`` documents with the smallest hash of their id, and the limits from
``LIMIT_DOCS`` more.  A sampled document stands for itself by ``WINDOWS`` windows of
``WINDOW`` characters spread evenly over all of it, which are the whole of a text
that is no longer.  They bound what is learned from, never what is predicted.

Edge cases: null texts, and texts without a letter, are ``und`` with score 0 and
rejected; ties go to the first language in alphabetical order; rows with null
lang or null text teach nothing; a null doc_id is never held out and never
learned from; an empty table, or one without labels, gives ``und`` throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, numbered, pick, table, worker

DICT_BYTES = 110_000
SAMPLE_DOCS = 256
WINDOWS, WINDOW = 16, 512
LANGS = 64
#: Short matches against the dictionary are what tells languages apart.
CODER = dict(
    window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=8, strategy=zstandard.STRATEGY_LAZY2,
    write_content_size=0, write_checksum=0, write_dict_id=0,
)
#: Share of the training documents that each of the three limits may reject.
FALSE_REJECTIONS = 0.01
LIMIT_DOCS = 200
#: Bytes of the segments that are encoded, and in each of which another language may be better.
SEGMENT = 512
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id"):
    """Whether a document belongs to the fold that teaches nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model(dict):
    """Dictionary content by language, and the limits of rejection (see :func:`limits`)."""

    limits: tuple[float, float, float] | None = None


def windows(text: Column, count: int = WINDOWS, width: int = WINDOW) -> Column:
    """``count`` windows of ``width`` characters, evenly spread from the first character to the last."""
    last = F.length(text) - width
    step = lambda i: F.substring(text, (F.floor(last * i / (count - 1)) + 1).cast("int"), F.lit(width))
    return F.when(last <= width * (count - 1), text).otherwise(F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), step)))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, langs: int = LANGS) -> Model:
    """Raw dictionary content by language, with limits; ``docs`` has doc_id, text, lang.

    Two scans: counts per language set a hash threshold for each, so that about
    twice the wanted documents pass; only the :func:`windows` of these reach the driver.
    """
    taught = pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    most = taught.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return Model()
    top = 1 << 63
    order = F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 1)
    shares = [(lang, min(top - 1, int(min(1.0, 2 * sample_docs / n) * top))) for lang, n in counts.items()]
    # A row for each learned language: at most ``langs``.
    limit = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, most long"))
    few = (
        taught.join(limit, "lang").filter(order <= F.col("most"))
        .select("lang", order.alias("h"), "doc_id", windows(F.col("text")).alias("text"))
        .orderBy("h", "doc_id")
        .limit(4 * sample_docs * len(counts))
        .collect()
    )
    parts: dict[str, list[bytes]] = {lang: [] for lang in counts}
    size = dict.fromkeys(counts, 0)
    others: dict[str, list[str]] = {lang: [] for lang in counts}
    for row in few:
        text = row["text"].lower().encode("utf-8", "replace")
        if len(parts[row["lang"]]) < sample_docs and size[row["lang"]] + len(text) <= dict_bytes:
            parts[row["lang"]].append(text)
            size[row["lang"]] += len(text)
        elif len(others[row["lang"]]) < LIMIT_DOCS:
            others[row["lang"]].append(row["text"])
    model = _dictionaries(parts)
    model.limits = limits(model, parts, others)
    return model


def _dictionaries(parts: dict[str, list[bytes]]) -> Model:
    # The nearest content costs the fewest bits, so earlier samples stand last.
    return Model({lang: b"\n".join(reversed(p)) for lang, p in sorted(parts.items()) if sum(map(len, p)) >= 8})


def limits(model: Model, parts: dict[str, list[bytes]], others: dict[str, list[str]]) -> tuple[float, float, float] | None:
    """Least margin, least gain and largest regret of a text that is not rejected.

    ``others`` are texts that the dictionaries don't hold.  Languages with fewer
    than half of ``LIMIT_DOCS`` of them are measured by halves of their samples,
    each with dictionaries made of the other halves.
    """
    whole = Classifier(model)
    known = {lang for lang, texts in others.items() if 2 * len(texts) >= LIMIT_DOCS}
    found = [whole.measure(t) for lang in known for t in others[lang] if any(map(str.isalpha, t))] if model else []
    if known != set(parts):
        for half in (0, 1):
            coder = Classifier(_dictionaries({lang: p[1 - half :: 2] for lang, p in parts.items()}))
            if len(coder.langs) == len(model):
                texts = [t.decode("utf-8", "ignore") for lang, p in parts.items() if lang not in known for t in p[half::2]]
                found += [coder.measure(t) for t in texts if any(map(str.isalpha, t))]
    if not found:
        return None
    margin, gain, regret = np.array([f[2:] for f in found]).T
    return (
        float(np.quantile(margin, FALSE_REJECTIONS, method="lower")), float(np.quantile(gain, FALSE_REJECTIONS, method="lower")),
        float(np.quantile(regret, 1 - FALSE_REJECTIONS, method="higher")),
    )


class Classifier:
    """Compressors, one for each language."""

    def __init__(self, model: dict[str, bytes]):
        self.langs = sorted(model)
        self.limits = getattr(model, "limits", None)
        self.plain = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**CODER))
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(**CODER)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        lang, score, margin, gain, regret = self.measure(text)
        least, helped, most = self.limits or (0.0, 0.0, math.inf)
        return lang, score, margin < least or gain < helped or regret > most

    def measure(self, text: str) -> tuple[str, float, float, float, float]:
        """Language, score, margin, gain on no dictionary, and regret: what other languages would save in single segments."""
        data = text.lower().encode("utf-8", "replace")
        segments = [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]
        costs = [[len(c.compress(b)) for b in segments] for c in self.coders]
        sizes = list(map(sum, costs))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        # With one language there is no runner-up and no margin to ask for.
        rest = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] + len(data))
        gap = rest - sizes[best]
        score = 1 - math.exp(-40 * gap / max(len(data), 32))
        gain = sum(len(self.plain.compress(b)) for b in segments) - sizes[best]
        regret = sizes[best] - sum(map(min, zip(*costs)))
        return self.langs[best], max(0.0, min(1.0, score)), gap / sizes[best], gain / sizes[best], regret / sizes[best]


def _predict(model: dict[str, bytes]):
    def run(batches):
        classify = Classifier(model)
        for batch in batches:
            said = [classify(t) for t in batch["text"].to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            langs, scores, rejected = zip(*said) if said else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in rest] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*rest, "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: dict[str, bytes], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and rejected; only ``text`` is looked at."""
    rows = numbered(docs).select(*[at(docs, c).alias(f"_k{i}") for i, c in enumerate(keep)], at(docs, "text").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(worker(_predict(model)), f"{schema}, lang_pred string, score double, rejected boolean")
    return out.toDF(*keep, "lang_pred", "score", "rejected")


def confident(docs: DataFrame, model: dict[str, bytes] | None = None) -> DataFrame:
    """The documents whose language is told with a sufficient margin, unchanged."""
    model = learn(docs) if model is None else model
    rows = numbered(docs).withColumn("text", at(docs, "text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(worker(_predict(model)), f"{schema}, lang_pred string, score double, rejected boolean")
    return out.filter("NOT rejected").drop("lang_pred", "score", "rejected").toDF(*docs.columns)


def op6_langid(spark, sf_dir) -> DataFrame:
    """The predicted language of every document."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    out = identify(docs.withColumn("held_out", held_out()), learn(docs), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
