"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Labelled documents are a holdout. In each stratum (language) one sequence of settings, each a cutoff for every rule, is
tested from the loosest on: the hypothesis that the rules together reject more than RISK of the good documents is
refuted if the exact binomial probability of as few rejections by any rule is small enough. The first setting that
fails ends the sequence (fixed-sequence testing needs no further correction). The order of the settings comes from the
bad documents alone, which are drawn apart from the good ones that test it; only strata share the error by Bonferroni.
Strata with too few good labels for any setting are one more group, tested together: the bound holds for the documents
of that group as a whole. Of the certified settings the one that rejects the most labelled bad documents is used;
without one, no rule rejects anything in that stratum.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm.shared import unpacked

#: Rules: shares of a text, large is bad.
RULES = ["symbol_share", "shout_share", "upper_share", "repeat_share", "dup_line_share"]
CUTOFFS = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]
#: False rejections of good documents allowed in a stratum (or the group of small ones), over all rules, and the chance of being wrong about any.
RISK, ERROR = 0.05, 0.05
#: Strata up to which the cutoffs are broadcast (five rows each).
MOST_BROADCAST_STRATA = 10_000
WINDOW = 8
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} double" for r in RULES)

_SPACE, _INNER, _SYMBOL, _UPPER, _LETTER = (np.zeros(256, np.int64) for _ in range(5))
_SPACE[[32, *range(9, 14)]] = 1
_INNER[128:192] = 1
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1
_LETTER[[*range(65, 91), *range(97, 123)]] = 1
_SHOUT = np.zeros(256, np.int64)
_SHOUT[ord("!")] = 1


def _repeated(words: list[bytes]) -> int:
    """Words in windows of eight that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    word = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = (window ^ (window >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(window, twice))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = shared.as_bytes(batch["text"])
        for a, b in shared.chunks(docs, 2 << 20):
            part = docs[a:b]
            data = np.frombuffer(b"".join(part), np.uint8)
            ends = np.cumsum([len(d) for d in part])
            rows = []
            for weight in (_SPACE, _INNER, _SYMBOL, _UPPER, _LETTER, _SHOUT):
                total = np.concatenate([[0], np.cumsum(weight[data])])
                rows.append(np.diff(total[np.concatenate([[0], ends])]))
            space, inner, symbols, upper, letters, shouts = rows
            chars = np.diff(np.concatenate([[0], ends])) - space - inner
            n_words, n_lines, n_dup, n_repeat = (np.zeros(len(part), np.int64) for _ in range(4))
            for i, doc in enumerate(part):
                words = doc.split()
                lines = [x for x in doc.split(b"\n") if not x.isspace() and x]
                n_words[i], n_lines[i], n_dup[i], n_repeat[i] = len(words), len(lines), len(lines) - len(set(lines)), _repeated(words)
            share = lambda x, y: x / np.maximum(y, 1)
            rules = [share(symbols, chars), share(shouts, chars), share(upper, letters), share(n_repeat, n_words), share(n_dup, n_lines)]
            names = [c.split()[0] for c in FEATURES.split(", ")]
            yield pa.record_batch(dict(zip(names, [batch["doc_id"].slice(a, b - a), *map(pa.array, (n_words, chars, symbols, n_dup, n_repeat, *rules))])))
            del data, total, part


def features(docs: DataFrame) -> DataFrame:
    """Counts and rule shares of every whole text (null: none), with its stratum and its MD5 as a name."""
    shared.bounded_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in _features(iter([batch])):
                text = batch["text"].slice(at, out.num_rows)
                names = [hashlib.md5(t, usedforsecurity=False).digest() for t in shared.as_bytes(text)]
                yield out.append_column("stratum", batch["stratum"].slice(at, out.num_rows)).append_column("name", pa.array(names, pa.binary()))
                at += out.num_rows
        shared.release()

    return columns.mapInArrow(run, FEATURES + ", stratum string, name binary")


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoff(good: list[int], bad: list[int], n_good: int, risk: float, error: float, steps: list = CUTOFFS):
    """good, bad: labelled documents that each of steps rejects, loosest first. The certified step of most bad; or None."""
    best, most = None, 0
    for step, k, hits in zip(steps, good, bad):
        if n_good == 0 or at_most(k, n_good, risk) > error:
            break
        if hits > most:
            best, most = step, hits
    return best


def least_good(risk: float, error: float) -> int:
    """Good documents from which a setting that rejects none of them is certified."""
    return math.ceil(math.log(error) / math.log1p(-risk) - 1e-9)


def sequence(level: np.ndarray, times: np.ndarray) -> list[list[int]]:
    """Settings from the loosest on, by bad documents alone: how many of CUTOFFS each rule has been tightened by.

    level: for each bad document (times: how often) and rule, the first setting that rejects it (one too many: none). The next rule and
    goal are those that reject the most further documents for each cutoff gone through; on the way there, cutoffs that
    reject nothing more are left out. A rule that gains nothing isn't tightened.
    """
    setting, out = [0] * level.shape[1], []
    left = np.ones(len(times), bool)
    while True:
        best, reach = (0.0, 0), None
        for r in range(len(setting)):
            above = np.bincount(level[left, r], times[left], len(CUTOFFS) + 2).cumsum()  # documents that each cutoff rejects
            for i in range(setting[r] + 1, len(CUTOFFS) + 1):
                if above[i] and (above[i] / (i - setting[r]), -i) > best:
                    best, reach = (above[i] / (i - setting[r]), -i), (r, i, above)
        if reach is None:
            return out
        r, goal, above = reach
        gained = 0
        for i in range(setting[r] + 1, goal + 1):
            if above[i] > gained:
                gained = above[i]
                out.append([*setting[:r], i, *setting[r + 1 :]])
        setting[r] = goal
        left &= level[:, r] > goal


def certify(level: np.ndarray, label: np.ndarray, times: np.ndarray, risk: float, error: float) -> list[int] | None:
    """The setting that is used for labelled documents (times: how often each occurs), or None."""
    steps = sequence(level[label == 0], times[label == 0])
    rejected = [(level <= np.array(s)).any(1) for s in steps]
    good, bad = ([int(times[hit & (label == y)].sum()) for hit in rejected] for y in (1, 0))
    return choose_cutoff(good, bad, int(times[label == 1].sum()), risk, error, steps)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(cut_stratum, cut_bound, cut_rule, cutoff) for the rules that are certified in a stratum; cut_bound: of the stratum, or pooled, for all small strata as a whole."""
    votes = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("int").alias("label"))
    # A bad document that the base test rejects needs no rule: it doesn't count in the order of the settings.
    useful = (F.col("label") == 1) | ~base_failed()
    held = measured.join(votes, F.col("doc_id") == F.col("label_id"))
    level = [(len(CUTOFFS) + 1 - sum((F.when(F.col(r) > c, 1).otherwise(0) for c in CUTOFFS), F.lit(0))).alias(r) for r in RULES]
    # A document counts once, however many rows or labels its id or its text has: of several versions the one that is rejected first.
    name = F.col("name") if "name" in measured.columns else F.col("doc_id").cast("string")
    rows = held.where(useful).select("doc_id", "stratum", "label", name.alias("name"), *level)
    worst = [F.min(r).alias(r) for r in RULES]
    ids = rows.groupBy("stratum", "doc_id").agg(F.min("label").alias("label"), F.min("name").alias("name"), *worst)
    once = ids.groupBy("stratum", "name").agg(F.min("label").alias("label"), *worst)
    counted = shared.written(once.groupBy("stratum", "label", *RULES).agg(F.count("*").alias("times")))
    sizes = counted.groupBy("stratum").agg(F.sum(F.when(F.col("label") == 1, F.col("times")).otherwise(0)).alias("n_good"))
    # Strata that could be certified alone, and one group of all others, share the error.
    first = sizes.agg(F.count_if(F.col("n_good") >= least_good(risk, error)).alias("large"), F.count("*").alias("strata")).first()
    groups = max(1, first["large"] + (first["strata"] > first["large"]))
    alone = F.col("n_good") >= least_good(risk, error / groups)
    member = sizes.select(F.col("stratum").alias("cut_stratum"), F.when(alone, F.concat(F.lit("s"), "stratum")).otherwise("rest").alias("cut_group"))
    grouped = counted.join(member, F.col("stratum") == F.col("cut_stratum")).groupBy("cut_group", "label", *RULES).agg(F.sum("times").alias("times"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        setting = certify(frame[RULES].to_numpy(np.int64), frame["label"].to_numpy(), frame["times"].to_numpy(), risk, error / groups)
        found = [(key[0], r, CUTOFFS[i - 1]) for r, i in zip(RULES, setting or []) if i]
        return pd.DataFrame(found, columns=["of_group", "cut_rule", "cutoff"])

    chosen = grouped.groupBy("cut_group").applyInPandas(run, "of_group string, cut_rule string, cutoff double")
    bound = F.when(F.col("cut_group") == "rest", "pooled").otherwise("stratum").alias("cut_bound")
    return member.join(chosen, F.col("cut_group") == F.col("of_group")).select("cut_stratum", bound, "cut_rule", "cutoff")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _wide(certified: DataFrame) -> DataFrame:
    """A row for each stratum with its certified cutoffs (null: none); broadcast if there are few."""
    wide = certified.groupBy("cut_stratum", "cut_bound").pivot("cut_rule", RULES).agg(F.first("cutoff"))
    wide = wide.select("cut_stratum", "cut_bound", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    held = wide.limit(MOST_BROADCAST_STRATA + 1).collect()
    return F.broadcast(wide.sparkSession.createDataFrame(held, wide.schema)) if len(held) <= MOST_BROADCAST_STRATA else wide


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs that judge() keeps, as they are, columns of any names included. Each is judged by its own text as it streams by.

    Null and empty texts fail the base test and go; a null language is a stratum of its own; rows that repeat stay or go
    alike, and null ids stay or go by their texts; an empty table stays empty.
    """
    wide = _wide(cutoffs(shared.written(features(docs)), labels, risk, error))
    rows = docs.select(shared.packed(docs).alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("cut_key"))
    beside = rows.join(wide, F.col("cut_key") == F.col("cut_stratum"), "left").drop("cut_key", "cut_stratum")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = unpacked(batch["row"], names)
            texts = held["text"].fill_null("")
            at = 0
            for measured in _features(iter([pa.record_batch({"doc_id": pa.nulls(batch.num_rows, pa.int64()), "text": texts})])):
                part, first = batch.slice(at, measured.num_rows), at
                at += measured.num_rows
                n_words, n_repeat = np.array(measured["n_words"]), np.array(measured["n_repeat_words"])
                bad = (n_words < 20) | (100 * n_repeat > 30 * n_words)
                for r in RULES:
                    cutoff = part[f"cut_{r}"].to_numpy(zero_copy_only=False).astype(float)
                    bad |= np.array(measured[r]) > np.where(np.isnan(cutoff), np.inf, cutoff)
                yield pa.RecordBatch.from_arrays([held[c].slice(first, len(bad)) for c in names], names).filter(pa.array(~bad))
        shared.release()

    return beside.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """A row for each row of docs: its counts, base_failed, kept, the rules that reject it, and for what the bound on false rejections holds:
    its stratum, small strata as a whole (pooled), or nothing (none: no rule is certified there).

    A null text has no words and fails; a null language is a stratum of its own; a doc_id labelled twice counts as bad
    if any label says so; repeated rows are judged alike; ids that labels lack only don't count in the holdout. Without
    labels no rule is certified, and only the base test rejects.
    """
    measured = shared.written(features(docs))
    certified = cutoffs(measured, labels, risk, error)
    joined = measured.join(_wide(certified), F.col("stratum") == F.col("cut_stratum"), "left")
    failing = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*names, base_failed().alias("base_failed"), (~base_failed() & (F.size(failing) == 0)).alias("kept"), F.concat_ws(",", failing).alias("failed_rules"), F.coalesce("cut_bound", F.lit("none")).alias("bound"))
