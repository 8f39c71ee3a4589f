"""Language identification by interpolated Kneser-Ney character models, one a language.

The models see the letters of a text in lower case, word by word, with a boundary mark (1) before and after.
Counting: each task counts the 4-grams of the distinct words of its texts; Spark adds them up and derives the
continuation counts of all lower orders, discounts and back-off weights, over all training documents. The
result, log probabilities already backed off and side by side for all languages, lies in arrays sorted by a
hash of the n-gram and is found by binary search. A text gets the language of the lowest cross-entropy a
character; if even that is above what documents have that the model has not learned from (a quantile of a tenth of them, left out
of the counts), it is rejected.

Every n-gram is kept. A model of more than `max_entries` n-grams is cut into shards by a hash of the last character
but one of an n-gram, which all that a 4-gram's probability backs off to has in common. A task holds one shard at a
time and adds up what each gives of a text, so memory follows neither the alphabet nor the number of languages.

Defined results: a null text, or one without letters, is `und` with score 0; a null language does not teach;
without any training document everything is `und`; ties go to the first language by code point; repeated
rows count each; an empty table gives no rows; a text is read whole, however long, texts of SLICE bytes at a time; characters
above U+FFFF share 2^15 numbers; other columns pass untouched, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ._common import Sealed, cut, documents, mix64, pieces_of, span_hashes, spans_of

ORDER = 4
EDGE = 1  # the mark at both ends of a word
MAX_ENTRIES = 4_000_000  # n-grams in a shard of a model, about, of 8 + 4 * languages bytes each
SHARPNESS = 4.0  # of the score, a softmax over cross-entropies
UNKNOWN = "und"
SLICE = 1 << 19  # bytes of text worked on at a time
QUANTILE, MARGIN = 0.999, 1.25  # of the cross-entropies of documents left out, and what is added for chance
WIDE = 32  # languages beyond which a shard has fewer n-grams
HELD = 1 << 25  # bytes of text that a task scores by one shard after the other


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Code points of all texts in lower case, starts and ends of their words, and the text of each."""
    joined = "".join(x.replace("\0", " ") + "\0" for x in texts).lower()
    units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends = spans_of(_letters()[np.minimum(units, 0x10FFFF)])
    return units, starts, ends, np.searchsorted(np.flatnonzero(units == 0), starts)


def grams_of(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of the words, 16 bits a character, each word's followed by that of its end; and where each word's begin."""
    n = ends - starts + 1
    begin = np.cumsum(n) - n
    pos = np.arange(n.sum()) - np.repeat(begin, n)
    at = np.minimum(np.repeat(starts, n) + pos, len(units) - 1)
    x = units[at].astype(np.uint64)
    x = np.where(x > 0xFFFF, (x ^ (x >> np.uint64(4))) & np.uint64(0xFFFF) | np.uint64(0x8000), x)
    x[begin + n - 1] = EDGE
    gram = x.copy()
    for k in range(1, ORDER):
        before = np.full(len(x), EDGE, np.uint64)
        before[k:] = x[:-k] if k < len(x) else x[:0]
        gram |= np.where(pos >= k, before, np.uint64(EDGE)) << np.uint64(16 * k)
    return gram, begin


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, c) of train (lang, text): 4-grams and how often each occurs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in pieces_of(batch, SLICE):
                langs = np.array(part.column("lang").to_pylist(), object)
                units, starts, ends, doc = words_of(part.column("text").to_pylist())
                h = span_hashes(units, starts, ends)
                for lang in sorted(set(langs)):
                    own = np.flatnonzero((langs == lang)[doc]) if len(doc) else doc
                    if not len(own):
                        continue
                    _, first, times = np.unique(h[own], return_index=True, return_counts=True)
                    gram, begin = grams_of(units, starts[own[first]], ends[own[first]])
                    n = np.diff(np.concatenate([begin, [len(gram)]]))
                    each, inverse = np.unique(gram, return_inverse=True)
                    c = np.bincount(inverse, weights=np.repeat(times, n)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(each), pa.string()), pa.array(each.view(np.int64)), pa.array(c)], ["lang", "gram", "c"])

    made = train.select("lang", "text").mapInArrow(run, "lang string, gram long, c long")
    return made.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def shard_of(char, shards: int):
    """The shard of n-grams by their last character but one: numbers, or a column of longs."""
    mixed = char * 40503  # a character has 16 bits
    if isinstance(char, np.ndarray):
        return (mixed >> 5) % shards
    return F.pmod(F.shiftrightunsigned(mixed, 5), F.lit(shards))


class Model:
    """Log probabilities of all languages, by order: hashes (sorted), and a row of the languages for each; of one shard of n-grams."""

    def __init__(self, langs: list[str], probs: list, backoffs: list, unseen: np.ndarray, shard: int = 0, shards: int = 1):
        self.langs, self.unseen, self.shard, self.shards = langs, unseen.astype(np.float32), shard, shards
        self.p: list[tuple[np.ndarray, np.ndarray]] = []
        self.b: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, ORDER + 1):
            grams, lang, value = probs[k - 1]
            keys = np.unique(grams)
            context, of, weight = backoffs[k - 1]
            ckeys = np.unique(context)
            gamma = np.zeros((len(ckeys), len(langs)), np.float32)
            gamma[np.searchsorted(ckeys, context), of] = weight
            order = np.argsort(self._hash(ckeys, k))
            self.b.append((self._hash(ckeys, k)[order], gamma[order]))
            rows = self._back(keys, k) if len(keys) else np.zeros((0, len(langs)), np.float32)
            rows[np.searchsorted(keys, grams), lang] = value
            order = np.argsort(self._hash(keys, k))
            self.p.append((self._hash(keys, k)[order], rows[order]))

    @staticmethod
    def _hash(keys: np.ndarray, k: int) -> np.ndarray:
        return mix64(keys + np.uint64((k * 0x9E3779B97F4A7C15) & (1 << 64) - 1))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
        return at, table[0][at] == hashes

    def _back(self, grams: np.ndarray, k: int) -> np.ndarray:
        """What grams of order k have where they were not seen: the context's weight and the shorter gram."""
        shorter = grams & np.uint64((1 << 16 * (k - 1)) - 1) if k > 1 else grams
        out = np.tile(self.unseen, (len(grams), 1)) if k == 1 else self.log_prob(shorter, k - 1)
        at, hit = self._find(self.b[k - 1], self._hash(grams >> np.uint64(16), k))
        if k > 1 and hit.any():
            out[hit] += self.b[k - 1][1][at[hit]]
        return out

    def log_prob(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        at, hit = self._find(self.p[k - 1], self._hash(grams, k))
        out = self.p[k - 1][1][at] if len(self.p[k - 1][0]) else np.zeros((len(grams), len(self.langs)), np.float32)
        if not hit.all():
            out[~hit] = self._back(grams[~hit], k)
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) log probability of what lies in the shard, and the characters of all (0: no letters)."""
        units, starts, ends, doc = words_of(texts)
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        if len(starts):
            _, first, inverse = np.unique(span_hashes(units, starts, ends), return_index=True, return_inverse=True)
            gram, begin = grams_of(units, starts[first], ends[first])
            if self.shards == 1:
                p = self.log_prob(gram)
            else:
                own = shard_of((gram >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64), self.shards) == self.shard
                p = np.zeros((len(gram), len(self.langs)), np.float32)
                p[own] = self.log_prob(gram[own])
            each = np.add.reduceat(p, begin, axis=0)
            n = (ends - starts + 1)[first]
            for j in range(len(self.langs)):
                total[:, j] = np.bincount(doc, weights=each[:, j][inverse], minlength=len(texts))
            count = np.bincount(doc, weights=n[inverse], minlength=len(texts))
        return total, count


class Shards:
    """A model in several broadcasts, of which a reader keeps one at a time."""

    def __init__(self, langs: list[str], sent: list):
        self.langs, self.sent = langs, sent

    def totals(self, groups: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Model.totals() of each group, over all shards."""
        out = []
        for one in self.sent:
            got = [one.value.totals(texts) for texts in groups]
            vars(one).pop("_value", None)  # else it would stay with the worker
            out = [(x + y, n) for (x, _), (y, n) in zip(out, got)] if out else got
        return out


def train_model(train: DataFrame, max_entries: int = MAX_ENTRIES) -> Model | Shards | None:
    """train: lang (not null), text (not null). None if there is nothing to learn."""
    c = cut(gram_counts(train))
    langs = [r["lang"] for r in c.select("lang").distinct().collect()]
    langs = sorted(langs, key=lambda x: x.encode())
    if not langs:
        return None
    shards = -(-c.count() * max(WIDE, len(langs)) // max(1, max_entries // 2 * WIDE))
    tables = {ORDER: c}
    for k in range(ORDER, 1, -1):  # how many different characters stand before: the continuation counts
        shorter = F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1).alias("gram")
        tables[k - 1] = tables[k].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("c"))
    index = {x: i for i, x in enumerate(langs)}
    alphabet = tables[1].select("gram").distinct().count() + 1
    made, unseen = [], np.zeros(len(langs))
    lower = None
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("context", F.shiftrightunsigned("gram", 16))
        few = t.groupBy("lang").agg(F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
        d = few.select("lang", F.when(F.col("n1") > 0, F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))).otherwise(0.1).alias("d"))
        context = t.groupBy("lang", "context").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("t")).join(d, "lang")
        context = context.withColumn("gamma", F.col("d") * F.col("t") / F.col("s"))
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("s")
        joined = t.join(context, ["lang", "context"])
        if lower is None:
            p = joined.withColumn("p", own + F.col("gamma") / alphabet)
        else:
            low = lower.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("low"))
            p = joined.withColumn("shorter", F.col("gram").bitwiseAND((1 << 16 * (k - 1)) - 1)).join(low, ["lang", "shorter"])
            p = p.withColumn("p", own + F.col("gamma") * F.col("low"))
        lower = cut(p.select("lang", "gram", "p"))
        made.append((lower, cut(context.select("lang", "context", "gamma")) if shards > 1 else context))

    def read(table: DataFrame, key: str, value: str, char, one: int):
        """What a shard has of a table; order 1 is in all."""
        some = table if char is None or shards == 1 else table.where(shard_of(char.bitwiseAND(0xFFFF), shards) == one)
        rows = some.select("lang", key, F.log(value).alias("v")).toArrow()
        of = np.array([index[x] for x in rows["lang"].to_pylist()], np.int64)
        return np.asarray(rows[key].combine_chunks()).view(np.uint64), of, np.asarray(rows["v"])

    def shard(one: int) -> Model:
        probs, backoffs = [], []
        for k, (p, context) in enumerate(made, 1):
            probs.append(read(p, "gram", "p", F.shiftrightunsigned("gram", 16) if k > 1 else None, one))
            backoffs.append(read(context, "context", "gamma", F.col("context") if k > 1 else None, one))
            if k == 1:
                unseen[backoffs[0][1]] = backoffs[0][2] - np.log(alphabet)
        return Model(langs, probs, backoffs, unseen, one, shards)

    if shards == 1:
        return shard(0)
    return Shards(langs, [train.sparkSession.sparkContext.broadcast(shard(one)) for one in range(shards)])


def _held(parts):
    """Lists of parts of about HELD bytes."""
    some, size = [], 0
    for part in parts:
        some.append(part)
        size += part.nbytes
        if size > HELD:
            yield some
            some, size = [], 0
    if some:
        yield some


PREDICTED = [("lang_pred", "string"), ("score", "double"), ("cross_entropy", "double")]


def predict(df: DataFrame, model: Model | None, key: list[str], text: str = "text") -> DataFrame:
    """key columns (which are not called as those that follow), lang_pred, score (0 to 1) and cross_entropy (null for `und`) of each row."""
    sent = model if isinstance(model, Shards) else df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([df.schema[c] for c in key])
    for name, kind in PREDICTED:
        schema = schema.add(name, kind)

    def run(batches):
        import pyarrow as pa

        m = sent if isinstance(sent, Shards) else sent.value
        parts = (part for batch in batches for part in pieces_of(batch, SLICE, text))
        for held in _held(parts) if isinstance(m, Shards) else ([part] for part in parts):
            groups = [[x or "" for x in part.column(text).to_pylist()] for part in held]
            ready = m.totals(groups) if isinstance(m, Shards) else [m and m.totals(texts) for texts in groups]
            for part, texts, found in zip(held, groups, ready):
                if m is None:
                    lang, score, entropy = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
                    none = np.ones(len(texts), bool)
                else:
                    total, count = found
                    e = -total / np.maximum(count, 1)[:, None]
                    best = e.argmin(axis=1)
                    entropy, none = e.min(axis=1), count == 0
                    soft = np.exp(-SHARPNESS * (e - entropy[:, None]))
                    score = np.where(none, 0.0, 1 / soft.sum(axis=1))
                    lang = [UNKNOWN if z else m.langs[b] for b, z in zip(best, none)]
                out = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64(), mask=none)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), *out], [*key, *(c for c, _ in PREDICTED)])

    return df.select(*key, *({text} - {*key})).mapInArrow(run, schema)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def is_calibration(doc_id, text):
    """A tenth of the documents, by hash: they are left out of the counts of the model that sets the threshold."""
    return F.pmod(F.xxhash64(F.lit("calibration"), doc_id, text), F.lit(10)) == 0


def rejection_threshold(judged: DataFrame) -> float:
    """Cross-entropy a character above which a text is in no learned language: MARGIN times the QUANTILE of rows of cross_entropy,
    which no model has learned from; infinite if there is none (all null)."""
    exact = judged.where("cross_entropy is not null").agg(F.percentile_approx("cross_entropy", QUANTILE, 100_000)).first()[0]
    return MARGIN * exact if exact is not None else float("inf")


def train_with_threshold(train: DataFrame) -> tuple[Model | Shards | None, float]:
    """The model of train (doc_id, text, lang), and the threshold for it.

    The model learns from all documents but a tenth; the threshold is calibrated on that tenth, all of it, at any size. Without a document in either
    part, all are learned from and nothing is rejected."""
    held = is_calibration(F.col("doc_id"), F.col("text"))
    model = train_model(train.where(~held))
    if model is None:
        return train_model(train), float("inf")
    left = train.where(held).select("text")
    return model, rejection_threshold(predict(left, model, []).select("cross_entropy"))


def rejected(limit: float):
    """Whether a row of predict() is in no learned language."""
    return (F.col("lang_pred") == UNKNOWN) | F.coalesce(F.col("cross_entropy") > limit, F.lit(False))


def reject_languages(docs: DataFrame) -> DataFrame:
    """docs without those whose language is `und` or whose cross-entropy is above the threshold."""
    seal = Sealed(docs)
    model, limit = train_with_threshold(training_rows(docs.select("doc_id", "text", "lang")))
    judged = predict(seal.df, model, seal.columns, seal["text"])
    return seal.opened(judged.where(~rejected(limit)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language and its score; whether its entropy is above the threshold, or it has none; a fifth of the documents teach nothing."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model, limit = train_with_threshold(training_rows(docs))
    found = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", rejected(limit).alias("rejected"))
