"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

Base spans (code points, end exclusive), leftmost and non-overlapping for each kind: email, ip (parts at most 255), card (13 to 19 digits
that pass Luhn's check) and phone (9 to 15 digits). A match that fails its check is dropped, without a retry.

Bootstrapping: base spans are seed instances. Every seed, and every other token that looks like an identifier
(``CANDIDATE``: at least ``MIN_LENGTH`` letters, digits and joining signs, four digits at least), is a mention
with lexical patterns: the two words before it, the word before and the word after it, and the label stuck to it (``name=`` or ``name:``).
Patterns and instances form a bipartite graph, whose weights are counted over the whole corpus. In each of ``ROUNDS``
rounds, a pattern's confidence is the mean confidence of its distinct instances, shrunk by ``PRIOR`` unknown ones, and an instance that isn't
a seed is as confident as the best of its patterns. Patterns of confidence ``CONFIDENT`` at least, and of at least ``SUPPORT`` distinct
instances, are accepted, however rare in the corpus. A candidate that an accepted pattern precedes or surrounds, and that overlaps no base
span, becomes a span of kind ``id``.

Frequent accepted patterns (at least ``SHARE`` of all pattern mentions, so at most 1 / SHARE of them) are broadcast. The others, of which there may be any
number, are joined with the candidates' patterns by shuffle, where no key has more than that share; what they find is joined with the rows by a hash of the text.

Texts are read twice (mentions, then spans), or three times if there are rare accepted patterns; they are shuffled only if these find more than
Spark's limit for broadcasts. Mentions are shuffled. Each text is read whole, in time linear in its length.
The graph's rounds work on counted edges, so that a pattern of a third of all mentions is one row for each of its instances.

Nulls and edges: null text is empty and has no spans. Repeated rows are judged one by one, and count once for each distinct instance. Without
seeds no pattern is accepted. Ties can't arise: spans are ordered by kind and start. Extra columns are kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import arrow_rows, give_back, materialise

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS = 4
PRIOR = 2.0
CONFIDENT = 0.6
SUPPORT = 5
SHARE = 1e-4
MIN_LENGTH = 6

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGIT = re.compile(r"[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
#: A token that may be an identifier, perhaps after a label: label in group 1, identifier in group 2.
CANDIDATE = re.compile(r"(?<!\S)([A-Za-z_]{2,24}[=:])?((?=[A-Za-z_/-]*[0-9])[A-Za-z0-9][A-Za-z0-9_/-]{4,}[A-Za-z0-9])(?=[.,;:!?)]*(?:\s|\Z))")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of tokens that look like identifiers and overlap no base span."""
    if not _DIGIT.search(text):
        return []
    taken = sorted((s, e) for _, s, e in base)
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span(2)
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if (k == len(taken) or taken[k][0] >= e) and e - s >= MIN_LENGTH and sum(c.isdigit() for c in m[2]) >= 4:
            out.append((s, e, (m[1] or "").lower()))
    return out


def _words_before(text: str, at: int, n: int = 2) -> list[str]:
    """The last n words before a place, lower-cased, the last first. Reads no more than needed, words cut at 40 characters."""
    out = []
    for _ in range(n):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and not text[at - 1].isspace() and end - at < 40:
            at -= 1
        if at == end:
            break
        out.append(text[at:end].lower())
    return out


def patterns(text: str, start: int, end: int, label: str = "") -> list[str]:
    """Lexical patterns around a place: what stands before it, around it, and stuck to it."""
    before = _words_before(text, start - len(label))
    m = _WORD.search(text, end) if end < len(text) and text[end].isspace() else None
    after = m[0][:40].lower().strip(".,;:!?()") if m else ""
    out = [f"{label}_"] if label else []
    if before:
        out.append(f"{before[0]} {label}_ {after}")
    if len(before) == 2:
        out.append(f"{before[1]} {before[0]} {label}_")
    return out


def mentions(docs: DataFrame) -> DataFrame:
    """(pattern, instance, seed): each pattern of each mention in the texts, instances as 64 bits of hash."""
    arrow_rows(docs.sparkSession)

    def read(batches):
        for b in batches:
            pattern, instance, seed = [], [], []
            for text in b.column(0).to_pylist():
                if not text or not _DIGIT.search(text) and "@" not in text:
                    continue
                base = base_spans(text)
                for s, e, label, known in [(s, e, "", True) for _, s, e in base] + [(*c, False) for c in candidates(text, base)]:
                    key = int.from_bytes(hashlib.blake2b(text[s:e].lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    for p in patterns(text, s, e, label):
                        pattern.append(p)
                        instance.append(key)
                        seed.append(known)
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.string()), pa.array(instance, pa.int64()), pa.array(seed, pa.bool_())], ["pattern", "instance", "seed"])
        give_back()

    return docs.select("text").mapInArrow(read, "pattern string, instance long, seed boolean")


def accepted_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of accepted patterns, from the graph of mentions."""
    edges = materialise(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "graph")
    whole = edges.agg(F.sum("n")).first()[0] or 0
    confidence = edges.select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("c"))
    scored = None
    for r in range(rounds):
        scored = confidence.groupBy("pattern").agg((F.sum("c") / (F.count("*") + PRIOR)).alias("confidence"), F.count("*").alias("instances"))
        if r == rounds - 1:
            break
        scored = materialise(scored.where("confidence > 0"), "patterns")
        raised = edges.join(scored.select("pattern", "confidence"), "pattern").where("NOT seed").groupBy("instance").agg(F.max("confidence").alias("raised"))
        confidence = materialise(edges.join(raised, "instance", "left").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("raised", F.lit(0.0))).alias("c")), "instances")
    support = edges.groupBy("pattern").agg(F.sum("n").alias("n"))
    accepted = scored.where((F.col("confidence") >= CONFIDENT) & (F.col("instances") >= SUPPORT)).join(support, "pattern")
    return accepted.select("pattern", "confidence", (F.col("n") >= SHARE * whole).alias("frequent"))


def learn(docs: DataFrame) -> tuple[frozenset[str], DataFrame | None]:
    """Frequent accepted patterns, of which there are at most 1 / SHARE, and a table of the others, if there are any."""
    accepted = materialise(accepted_patterns(mentions(docs)), "accepted")
    rare = accepted.where("NOT frequent").select("pattern")
    return frozenset(r.pattern for r in accepted.where("frequent").collect()), None if rare.isEmpty() else rare


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ``__key``: a hash of the text, or for texts without digits, in which nothing can be found, of the row, so that they spread."""
    row = F.concat(F.lit("-"), F.hex(F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])))
    return docs.withColumn("__key", F.when(F.col("text").rlike("[0-9]"), F.sha2("text", 256)).otherwise(row))


def found_by(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """docs with ``__found``: the (s, e) of the text's candidates that a pattern of the table is around; null without any."""
    arrow_rows(docs.sparkSession)

    def read(batches):
        for b in batches:
            key, start, end, pattern = [], [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s, e, label in candidates(text, base_spans(text)):
                    for p in patterns(text, s, e, label):
                        key.append(k)
                        start.append(s)
                        end.append(e)
                        pattern.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(pattern, pa.string())], ["__key", "s", "e", "pattern"])
        give_back()

    keyed = _keyed(docs)
    held = keyed.where(F.col("text").rlike("[0-9]")).select("__key", "text").mapInArrow(read, "__key string, s long, e long, pattern string")
    # Written first, so that Spark knows their size and moves the texts only if the hits are too many to send.
    hits = materialise(held.join(rare, "pattern", "left_semi").groupBy("__key").agg(F.collect_set(F.struct("s", "e")).alias("__found")), "found")
    return keyed.join(hits, "__key", "left").drop("__key")


def spans(text: str, accepted: frozenset[str], found: frozenset[tuple[int, int]] = frozenset()) -> list[tuple[str, int, int]]:
    """Base spans, and candidates that an accepted pattern is around or that are found already."""
    base = base_spans(text)
    return base + [("id", s, e) for s, e, label in (candidates(text, base) if accepted or found else ()) if (s, e) in found or not accepted.isdisjoint(patterns(text, s, e, label))]


def _places(batch: pa.RecordBatch) -> list[frozenset[tuple[int, int]]]:
    """``__found`` of each row, empty where it is null or absent."""
    if "__found" not in batch.schema.names:
        return [frozenset()] * batch.num_rows
    return [frozenset((x["s"], x["e"]) for x in f or ()) for f in batch.column("__found").to_pylist()]


def _joined(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def extract(docs: DataFrame, accepted: frozenset[str] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans) of every row of docs."""
    arrow_rows(docs.sparkSession)
    frequent, rare = learn(docs) if accepted is None else (accepted, None)
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    fields = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def read(batches):
        for b in batches:
            found = [spans(t or "", held.value, f) for t, f in zip(b.column("text").to_pylist(), _places(b), strict=True)]
            counts = [pa.array([sum(x[0] == k for x in f) for f in found], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(_joined(x for x in f if x[0] != "id").encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array([_joined(f) for f in found], pa.string())], fields)
        give_back()

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")
    return (rows if rare is None else found_by(rows, rare)).mapInArrow(read, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, accepted: frozenset[str] | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in capitals and brackets (of overlapping spans, the one that starts first, then the longest, names the whole stretch); n_chars, where there is one, follows."""
    arrow_rows(docs.sparkSession)
    frequent, rare = learn(docs) if accepted is None else (accepted, None)
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    at, docs_columns = docs.columns.index("text"), docs.columns

    def clean(text, found):
        if not text:
            return text
        found = sorted((s, -e, k) for k, s, e in spans(text, held.value, found))
        if not found:
            return text
        out, done = [], 0
        for s, e, k in found:
            if s < done:
                if -e > done:
                    done = -e
                continue
            out += [text[done:s], f"[{k.upper()}]"]
            done = -e
        return "".join([*out, text[done:]])

    def read(batches):
        for b in batches:
            texts = pa.array([clean(t, f) for t, f in zip(b.column(at).to_pylist(), _places(b), strict=True)], pa.string())
            yield b.set_column(at, "text", texts).select(docs_columns)
        give_back()

    out = (docs if rare is None else found_by(docs, rare)).mapInArrow(read, T.StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
