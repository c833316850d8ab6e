"""Quality rules as a bitmask ledger.

Every rule is evaluated once.  The ledger holds a document's measurements and one bit per failed
rule; a policy is a versioned set of bits, applied later by a bitwise AND, and an ablation (what
would be kept without a rule) is a group-by over the masks, of which there are at most 2^rules.

Defined results: null or blank text has no words, fails `short` and is rejected; a word's repeats
are looked for in its own row only, so repeated rows get equal results; very long texts are
measured whole; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_WORD, per_document, slices, windows, with_columns, word_hashes

#: Rule names by bit.
RULES = ("short", "repeated_windows", "symbols", "duplicate_lines", "shouting", "one_word", "long_words")
#: Policy versions: the rules that reject a document.
POLICIES = {
    "base": ("short", "repeated_windows"),
    "v1": RULES,
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[97:123] = True
_BLANK = " \t\n\r\x0b\x0c"

LEDGER = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_ascii_letters long, n_top_word long, failed long"


def mask_of(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements and failure bits of each document of a slice."""
    n = len(offsets) - 1
    hashes, docs = word_hashes(data, offsets, lower=False)
    m = {"n_words": np.bincount(docs, minlength=n).astype(np.int64)}
    m["word_chars"] = per_document(IS_WORD[data] & ((data & 0xC0) != 0x80), offsets)
    m["n_symbols"] = per_document(_SYMBOL[data], offsets)
    raw = data.tobytes()
    m["n_lines"], m["n_dup_lines"] = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        m["n_lines"][i], m["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
    m["n_repeat_words"] = _repeated(hashes, docs, n, 8)
    m["n_upper"] = per_document(_UPPER[data], offsets)
    m["n_ascii_letters"] = per_document(_ASCII_LETTER[data], offsets)
    m["n_top_word"] = _most_common(hashes, docs, n)
    m["failed"] = failures(m)
    return m


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """One bit per failed rule.  Integer comparisons only, so the bits don't depend on rounding."""
    words = m["n_words"]
    bits = {
        "short": words < 20,
        "repeated_windows": 100 * m["n_repeat_words"] > 30 * words,
        "symbols": 100 * m["n_symbols"] > 10 * m["word_chars"],
        "duplicate_lines": 100 * m["n_dup_lines"] > 50 * m["n_lines"],
        "shouting": (100 * m["n_upper"] > 40 * m["n_ascii_letters"]) & (2 * m["n_ascii_letters"] >= m["word_chars"]),  # of texts mostly in A-Z
        "one_word": (100 * m["n_top_word"] > 30 * words) & (words >= 20),
        "long_words": m["word_chars"] > 40 * words,
    }
    return sum(bits[r].astype(np.int64) << k for k, r in enumerate(RULES))


def _repeated(hashes, docs, n, width) -> np.ndarray:
    """Words that lie in a window found twice or more in their document."""
    keys, start = windows(hashes, docs, width)
    if not len(keys):
        return np.zeros(n, np.int64)
    order = np.lexsort((keys, docs[start]))
    k, d = keys[order], docs[start][order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(k), bool)
    again[1:] |= same
    again[:-1] |= same
    cover = np.zeros(len(hashes) + 1, np.int64)
    hit = start[order[again]]
    cover[hit] += 1
    cover[hit + width] -= 1
    return np.bincount(docs, weights=np.cumsum(cover[:-1]) > 0, minlength=n).astype(np.int64)


def _most_common(hashes, docs, n) -> np.ndarray:
    """How often each document's most frequent word occurs."""
    out = np.zeros(n, np.int64)
    if len(hashes):
        order = np.lexsort((hashes, docs))
        h, d = hashes[order], docs[order]
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
        np.maximum.at(out, d[head], np.diff(np.append(head, len(h))))
    return out


def _isspace_is_ascii() -> bool:
    return all(bytes([c]).isspace() == (chr(c) in _BLANK) for c in range(256))


assert _isspace_is_ascii()


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the rules that each document fails."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            yield with_columns(rows, ["doc_id"], **measure(data, offsets))

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {LEDGER}")
    return out.withColumnRenamed("doc_id", doc_id)


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """Adds `kept`: no rule of the policy has failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0)


def ablations(entries: DataFrame, version: str = "v1") -> DataFrame:
    """rule, n_failed, n_only (rejected by this rule alone) under a policy, over at most 2^rules masks."""
    policy = mask_of(POLICIES[version])
    masks = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy).cast("long")).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[version]))
    each = masks.select("mask", "n", F.explode(rules).alias("r")).select("mask", "n", "r.rule", "r.bit")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


def keep_good(docs: DataFrame, text: str = "text", version: str = "v1") -> DataFrame:
    """The rows that the policy keeps, with all their columns."""
    policy = mask_of(POLICIES[version])

    def run(batches):
        for rows, data, offsets in slices(batches, text):
            yield rows.filter(pa.array((measure(data, offsets)["failed"] & policy) == 0))

    return docs.mapInArrow(run, docs.schema)
