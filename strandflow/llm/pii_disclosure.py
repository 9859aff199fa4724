"""Personal data: detected entities, and terms that reveal them.

Base entities (email, ip, card, phone) come from patterns. Around each occurrence, the words within `window` words are its
context. Over the whole corpus, n(t, e) counts occurrences of term t in contexts of entity e and n(t) all its
occurrences, so n(t, e) / n(t) estimates p(e | t), how surely the term reveals the entity (2^PMI times p(e)). Terms
with at least `support` occurrences in contexts and p(e | t) of at least `disclose` become spans of kind `term` wherever
they occur, in contexts or not, with the largest p of their entities. Sanitising puts an entity's kind in its place, removes terms
of at least `remove`, and generalises the others to what kind of word they are (number, code, name or word).

Three scans: contexts, counts of the terms in them, and the spans of every row, where a bit set thins the words before the
exact join with the terms. Rows are told apart by a number of the last scan, so none of them needs a key.

Defined results: null text counts as empty and has no spans; matches that fail their check are dropped without a
retry; repeated rows count as often as they occur; rows with a null key are rows like others; an empty table gives no rows;
other columns are not read. A term is a word with A-Z lower-cased; words that overlap a base span are no terms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import _bloom
from strandflow.llm._store import written
from strandflow.llm._text import buffers, slices, words

KINDS = ("email", "ip", "card", "phone", "term")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins at the first digit of a run in any case; the look-behind only saves trying the others.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Local parts reach back from their @ to a character they cannot hold, or to the last match."""
    end = 0
    for m in _AT.finditer(text):
        a = m.start()
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            end = m.end()
            yield a, end


def base_spans(text: str) -> list[Span]:
    """(start, kind, end), sorted: leftmost non-overlapping matches of each kind that pass its check."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value.lower()}".encode(), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, spans: list[Span], window: int) -> list[tuple[int, int]]:
    """(term, entity) of the words around each span; each word once per entity."""
    w = words(pa.array([text], pa.large_string()), lower=True)
    chars = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    start, end = chars[w.starts], chars[w.ends]
    free = np.ones(len(start), dtype=bool)
    for a, _, b in spans:
        free[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = False
    out = {}
    for a, k, b in spans:
        e = _entity(k, text[a:b])
        lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        for i in [*range(max(0, lo - window), lo), *range(hi, min(len(start), hi + window))]:
            if free[i]:
                out[i, e] = (int(w.hashes[i].view(np.int64)), e)
    return list(out.values())


def _contexts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                out = [c for text in b.column(0).to_pylist() if text and (spans := base_spans(text)) for c in contexts(text, spans, window)]
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in out], pa.int64()) for k in range(2)], ["term", "entity"])

    return run


def _marks(texts: pa.Array, bits: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By text: (term, start, end) of its words that the bit set holds, counted in characters."""
    w = words(texts, lower=True)
    at = np.flatnonzero(_bloom.has(bits, w.hashes))
    if not len(at):
        return {}
    chars = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    of = np.searchsorted(w.first, at, "right") - 1
    zero = chars[buffers(texts)[1][of]]
    term, start, end = w.hashes[at].view(np.int64), chars[w.starts[at]] - zero, chars[w.ends[at]] - zero
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    return {int(of[a]): (term[a:b], start[a:b], end[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, kind array<int>, start array<long>, end array<long>, term array<long>, t_start array<long>, t_end array<long>"


def _detect(bits):
    """Passes on all columns but the last, the text, and adds _FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, dtype=np.int64),) * 3
        for batch in batches:
            for b in slices(batch, batch.schema.names[-1]):
                rows, texts = [], b.column(b.num_columns - 1)
                marks = _marks(texts, bits.value)
                for i, text in enumerate(texts.to_pylist()):
                    spans = base_spans(text) if text else []
                    term, start, end = marks.get(i, none)
                    free = np.ones(len(term), dtype=bool)
                    for x, _, y in spans:
                        free[np.searchsorted(end, x, "right") : np.searchsorted(start, y, "left")] = False
                    n = [sum(k == j for _, k, _ in spans) for j in range(4)]
                    rows.append((*n, hashlib.sha256(joined(spans).encode()).hexdigest(), [k for _, k, _ in spans], [a for a, _, _ in spans], [e for _, _, e in spans], term[free], start[free], end[free]))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32())] + [pa.list_(pa.int64())] * 5
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*b.schema.names[:-1], *(x.split()[0] for x in _FOUND.split(", "))])

    return run


def _term_counts(bits, most: int = 1 << 22):
    """Occurrences of candidate terms, summed over a few million words before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            key, at = np.unique(np.concatenate(held), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, minlength=len(key)), pa.int64())], ["term", "n"])

        for batch in batches:
            for b in slices(batch):
                h = words(b.column(0), lower=True).hashes
                h = h[_bloom.has(bits.value, h)]
                held.append(h)
                n += len(h)
                if n >= most:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def revealing_terms(docs: DataFrame, text: str = "text", window: int = 10, support: int = 3, disclose: float = 0.5) -> DataFrame:
    """(term, entity, p) of the pairs over the threshold, from counts over all documents."""
    t = docs.select(F.col(text).alias("text"))
    pairs = t.mapInArrow(_contexts(window), "term long, entity long").groupBy("term", "entity").agg(F.count("*").alias("near")).where(F.col("near") >= support)
    pairs = written(pairs, "pairs")
    bits = docs.sparkSession.sparkContext.broadcast(_bloom.build(pairs.select("term").distinct()))
    total = t.mapInArrow(_term_counts(bits), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    p = F.col("near") / F.col("n")
    return pairs.join(total, "term").where(p >= disclose).select("term", "entity", p.alias("p"))


def detect(docs: DataFrame, terms: DataFrame, keep: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base entities and the words that may be one of `terms`, a row per row, written with a number `row`; keep: with the text."""
    bits = docs.sparkSession.sparkContext.broadcast(_bloom.build(terms.select("term")))
    d = docs.select(F.col(key).cast("long").alias("doc_id"), *[F.col(text).alias("kept")] * keep, F.col(text).alias("text"))
    found = d.mapInArrow(_detect(bits), "doc_id long, " + "kept string, " * keep + _FOUND)
    return written(found.withColumn("row", F.monotonically_increasing_id()), "entities")


def _all_spans(docs: DataFrame, keep: bool, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    terms = written(revealing_terms(docs, text, **options).groupBy("term").agg(F.max("p").alias("p")), "terms")
    found = detect(docs, terms, keep, key, text)
    at = found.select("row", F.explode(F.arrays_zip("term", "t_start", "t_end")).alias("x")).select("row", "x.*").join(terms, "term")
    at = at.groupBy("row").agg(F.collect_list(F.struct(F.col("t_start").alias("start"), F.lit(4).alias("kind"), F.col("t_end").alias("end"), "p")).alias("added"))
    base = F.transform(F.arrays_zip("start", "kind", "end"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(1.0).alias("p")))
    out = found.join(at, "row", "left")
    return out.withColumn("spans", F.array_sort(F.concat(base, F.coalesce("added", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,p:double>>)")))))


def all_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 10, support: int = 3, disclose: float = 0.5) -> DataFrame:
    """(doc_id, row, n_email, n_ip, n_card, n_phone, base_sha256, spans): spans as an array of (start, kind, end, p), sorted."""
    out = _all_spans(docs, False, key, text, window=window, support=support, disclose=disclose)
    return out.select("doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def spans_text(spans) -> F.Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def generalised(term: str) -> str:
    """What kind of word a term is."""
    if any(c.isdigit() for c in term):
        return "<NUMBER>" if not any(c.isalpha() for c in term) else "<CODE>"
    return "<NAME>" if term[:1].isupper() else "<WORD>"


def rewrite(text: str, spans: list[dict], remove: float) -> str:
    """The text without its spans (start, kind, end, p; sorted). Spans that overlap are one, in the kind of the first."""
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            own = text[s["start"] : s["end"]]
            parts += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>" if s["kind"] < 4 else "" if s["p"] >= remove else generalised(own)]
        at = max(at, s["end"])
    return "".join(parts) + text[at:]


def _rewrite(remove: float):
    """Rows (text, spans, ...): ..., safe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else rewrite(t, s or [], remove) for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.string())], [*b.schema.names[2:], "safe"])

    return run


def with_safe(docs: DataFrame, key: str = "doc_id", text: str = "text", remove: float = 0.9, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, safe): what all_spans finds, and the sanitised text, null for null."""
    found = _all_spans(docs, True, key, text, **options)
    rows = found.select("kept", F.col("spans").alias("spans_"), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_text("spans").alias("spans"))
    return rows.mapInArrow(_rewrite(remove), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, safe string")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", remove: float = 0.9, **options) -> DataFrame:
    """(doc_id, text): every row's own text without its entities and disclosing terms, whatever its key."""
    return with_safe(docs, key, text, remove, **options).select("doc_id", F.col("safe").alias("text"))
