"""Mixing sources to target weights by soft membership, in DataFrame functions only.

1. A classifier learns domains from a table of labelled ids (a bounded sample of its rows,
   broadcast). Naive Bayes over presence and absence of at most ``max_words`` words, those by
   which a domain stands out most from the rest, and over binned shape ratios. Every
   document gets posteriors p[d, k].
2. Document rates r[d] >= 0 minimise ``sum_k (S_k - t_k)^2 / T_k`` by projected gradients:
   S_k = sum_d r[d] n[d] p[d, k] are the expected domain token totals, t_k their targets and
   T_k the totals at rate one. In the metric of the token counts n the gradient of r[d] is
   ``sum_k p[d, k] y_k`` with y_k = (S_k - t_k) / T_k, and its slope is at most one, so steps
   have length one: the gradients add up and the sum is projected,
   ``r = clip(1 + sum_k p[d, k] l_k)`` with K accumulated multipliers l, Nesterov's momentum
   and a restart where it points uphill. Starting from one and adding up leads to the rates
   nearest to one among those that reach the targets. A round is one aggregation of K sums
   over the distinct posteriors with their token totals, a narrow checkpointed table.
   Rounds end when the targets are met, or when the projected gradient is too small to explain
   more than ``HIDDEN`` of the miss; a miss is reported by a :class:`MissedTargets` warning,
   unfinished rounds by an error.

A rate becomes a whole number of copies by a hash of id and text: its whole part, plus one
with the probability of its fraction.

Domains of the default label rule: ``toxic``, ``low`` (quality 0) and ``clean``.

Defined results: null texts have no tokens and the shape of an empty text; null labels
count as not set; a labelled id that repeats counts once a label row; without any usable label the
posteriors are uniform; repeated rows give repeated rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ascii_lower, let, sampled, text_or_empty, words_of
from docweave.llm.quality_rules import SPACES, SYMBOLS

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}
FIT_ROWS = 20_000
MAX_WORDS = 256
MIN_DOCS = 5             # documents of the sample a word must be in
MIN_Z = 6.0              # standard errors by which its share in a domain must exceed the rest's
MIN_LIFT = 5.0           # and times: words that a domain merely has fewer of tell nothing
ROUNDS = 500             # aggregations after which the fit fails; soft posteriors need 20 to 150
ROWS_PER_TASK = 100_000  # distinct posteriors that a task of a round sums up
TOLERANCE = 1e-4         # largest miss of a domain, as a share of all target tokens
HIDDEN = 1e-7            # share of the objective that the projected gradient may still explain


class MissedTargets(UserWarning):
    """No rates within their bounds reach the targets; the nearest are returned."""


def label_domain() -> Column:
    """Domain of a row of ``labels(doc_id, quality, toxic)``; null if nothing is set."""
    return (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
            .when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), "clean"))


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_tokens, parts`` (distinct lower-case letter runs) and ``shape`` (bin names)."""
    def number(chars: str) -> Column:
        return F.regexp_count("t", F.lit(f"[{chars}]"))

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    rows = rows.select("id", "t", F.split(ascii_lower(F.col("t")), r"[^\p{L}\p{N}]+").alias("all"),
                       F.size(words_of(F.col("t"))).cast("long").alias("n_tokens"))
    lines = F.split("t", "\n")
    rows = rows.select("id", "n_tokens", F.array_distinct("all").alias("parts"),
                       F.size("all").alias("n"), number(SYMBOLS).alias("symbols"),
                       number("A-Z").alias("upper"), number(SPACES).alias("spaces"),
                       F.char_length("t").alias("chars"),
                       let(lines, lambda x: F.size(F.array_distinct(x)) / F.size(x)).alias("lines"))

    def bin_of(name: str, ratio: Column, *edges: float) -> Column:
        place = reduce(lambda a, e: a + (ratio > e).cast("int"), edges, F.lit(0))
        return F.concat(F.lit(f"{name}:"), place.cast("string"))

    one = F.lit(1)
    return rows.select("id", "n_tokens", "parts", F.array(
        bin_of("symbols", F.col("symbols") / F.greatest("n_tokens", one), 0.05, 0.3, 0.8),
        bin_of("upper", F.col("upper") / F.greatest(F.col("chars") - F.col("spaces"), one), 0.1, 0.4),
        bin_of("distinct", F.size("parts") / F.greatest("n", one), 0.1, 0.3, 0.5),
        bin_of("lines", F.col("lines"), 0.3, 0.6),
        bin_of("length", F.col("n_tokens"), 20, 50, 200)).alias("shape"))


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id",
                text_col: str = "text", domains=DOMAINS, fit_rows: int = FIT_ROWS,
                max_words: int = MAX_WORDS) -> dict:
    """Naive Bayes tables from ``labelled(id, domain)``: ``{"prior": [...], "words": {word:
    log likelihoods}, "shape": {bin: log likelihoods}}``, at most ``max_words`` words."""
    labelled = sampled(labelled.where(F.col("domain").isin(*domains) & F.col("id").isNotNull()), fit_rows, 29)
    labelled = labelled.select(F.col("id").alias("_llm_id"), F.col("domain").alias("_llm_domain")).checkpoint()
    texts = docs.join(F.broadcast(labelled), F.col(id_col) == F.col("_llm_id"))
    texts = sampled(texts, fit_rows, 31)                # ids may repeat in the documents too
    rows = (_features(texts.select(F.struct(id_col, "_llm_domain").alias("id"), text_col), "id", text_col)
            .select(F.col("id._llm_domain").alias("domain"), "parts", "shape").checkpoint())

    def by_domain(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}")
                                       for i, d in enumerate(domains)])

    sizes = [*by_domain(rows).first()]
    total = max(1, sum(sizes))

    def spread(i: int) -> Column:           # how far domain i's share is above the others'
        inside, rest = max(1, sizes[i]), max(1, total - sizes[i])
        k = reduce(lambda a, b: a + b, [F.col(f"n{j}") for j in range(len(domains))])
        p = (k + 1) / (total + 2)
        here, there = F.col(f"n{i}") / inside, (k - F.col(f"n{i}")) / rest
        z = (here - there) / F.sqrt(p * (1 - p) * (1 / inside + 1 / rest))
        return F.when(here >= MIN_LIFT * there, z).otherwise(F.lit(0.0))

    counts = by_domain(rows.select("domain", F.explode("parts").alias("part")), "part")
    enough = reduce(lambda a, b: a + b, [F.col(f"n{j}") for j in range(len(domains))]) >= MIN_DOCS
    words = (counts.where(enough & (F.col("part") != ""))
             .withColumn("z", F.greatest(*[spread(i) for i in range(len(domains))]))
             .where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "part").limit(max_words).collect())
    shape = by_domain(rows.select("domain", F.explode("shape").alias("part")), "part").collect()

    def logs(r) -> list[float]:
        return [math.log((r[f"n{i}"] + 0.5) / (sizes[i] + 1)) for i in range(len(domains))]

    prior = [math.log((s + 1) / (total + len(domains))) for s in sizes]
    if not sum(sizes):
        prior = [0.0] * len(domains)
    present = {r.part: logs(r) for r in words}
    for i in range(len(domains)):           # every word absent; a present word takes it back
        for p in present.values():
            prior[i] += math.log1p(-math.exp(p[i]))
            p[i] -= math.log1p(-math.exp(p[i]))
    return {"prior": prior, "words": present,
            "shape": {r.part: logs(r) for r in shape}}


def _lookup(table: dict[str, list[float]], i: int) -> Column:
    """The table's ``i``-th likelihoods as a constant map (bounded by ``max_words``)."""
    items = [F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v[i]))]
    return F.create_map(*items)


def _sum_of(parts: Column, table: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.coalesce(
        F.try_element_at(table, x), F.lit(0.0)))


def posteriors(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
               domains=DOMAINS) -> DataFrame:
    """``id, n_tokens, p_<domain>...`` per document."""
    rows = _features(docs, id_col, text_col)
    if model["words"]:
        rows = rows.withColumn("parts", F.array_intersect(
            "parts", F.array(*[F.lit(w) for w in sorted(model["words"])])))

    def total(i: int) -> Column:
        out = F.lit(model["prior"][i])
        for name, col in (("words", "parts"), ("shape", "shape")):
            if model[name]:
                out = out + _sum_of(F.col(col), _lookup(model[name], i))
        return out

    rows = rows.select("id", "n_tokens", *[total(i).alias(f"s{i}") for i in range(len(domains))])
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(domains))])
    rows = rows.select("id", "n_tokens", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}")
                                           for i in range(len(domains))])
    whole = reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in range(len(domains))])
    return rows.select("id", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p_{d}")
                                           for i, d in enumerate(domains)])


def fit_rates(rows: DataFrame, targets: dict[str, float], budget: float | None = None,
              max_rate: float | None = None, rounds: int = ROUNDS,
              tolerance: float = TOLERANCE, whole: str | None = None) -> DataFrame:
    """``rows(n_tokens, p_<domain>...)`` with the fitted ``rate``.

    ``budget``: all target tokens (default: the tokens there are). ``max_rate``: an upper
    bound of every rate, projected on like the lower one. ``whole``: a domain that is not to be
    thinned; the budget is raised until its target is at least its total, and under ``max_rate``
    the other domains' targets are at most what they can give. Raises if the fit is not done after
    ``rounds`` aggregations; warns with :class:`MissedTargets` if the targets are out of reach."""
    names = [f"p_{d}" for d in targets]
    share = sum(targets.values())
    rows = rows.checkpoint()
    table = rows.groupBy(*names).agg(F.sum("n_tokens").alias("n")).checkpoint()
    table = table.coalesce(max(1, -(-table.count() // ROWS_PER_TASK)))      # every round runs these tasks

    def dot(x: np.ndarray) -> Column:
        return reduce(lambda a, b: a + b, [F.col(p) * F.lit(float(v)) for p, v in zip(names, x)])

    def clip(raw: Column) -> Column:
        raw = F.greatest(F.lit(0.0), raw)
        return raw if max_rate is None else F.least(F.lit(float(max_rate)), raw)

    def sums(at: np.ndarray, before: tuple | None) -> tuple[np.ndarray, float]:
        """Totals at the multipliers ``at``, and the size of the projected gradient at the
        point and gradient ``before``."""
        rate = clip(F.lit(1.0) + dot(at))
        left = F.lit(0.0)
        if before:
            old = clip(F.lit(1.0) + dot(before[0]))
            left = old - clip(old - dot(before[1]))
        r = table.agg(*[F.sum(rate * F.col("n") * F.col(p)) for p in names],
                      F.sum(F.col("n") * left * left)).first()
        x = [float(v or 0.0) for v in r]
        return np.array(x[:-1]), x[-1]

    at = last = np.zeros(len(names))
    now, _ = sums(at, None)
    weight = np.maximum(now, 1.0)
    budget = float(now.sum()) if budget is None else budget
    if whole is not None and targets[whole] > 0:
        budget = max(budget, float(now[names.index(f"p_{whole}")]) * share / targets[whole])
    want = budget * np.array([*targets.values()]) / share
    if whole is not None and max_rate is not None:      # a domain there is too little of is just kept
        want = np.where(np.array([*targets]) == whole, want, np.minimum(want, weight * max_rate))

    def met() -> bool:
        return not budget or float(np.abs(now - want).max()) <= tolerance * budget

    pace, calls = 1.0, 1
    while not met():
        if calls >= rounds:
            raise RuntimeError(f"rates not fitted after {rounds} rounds: {now} of {want} tokens")
        slope = (now - want) / weight
        stepped = at - slope
        if (now - want) @ (stepped - last) > 0:
            pace = 1.0
        ahead = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        new = stepped + (pace - 1) / ahead * (stepped - last)
        objective = float(((now - want) ** 2 / weight).sum())
        totals, left = sums(new, (at, slope))
        calls += 1
        if left <= HIDDEN * objective:                  # ``at`` is as near as rates can get
            break
        last, at, now, pace = stepped, new, totals, ahead
    if not met():
        said = ", ".join(f"{d} {s:.6g} of {t:.6g}" for d, s, t in zip(targets, now, want))
        warnings.warn(f"mixing targets out of reach, nearest expected tokens: {said}", MissedTargets, stacklevel=2)
    return rows.withColumn("rate", clip(F.lit(1.0) + dot(at)))


def copies_of(id_col: str, rate: str, seed: int = 7) -> Column:
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col(rate) + unit).cast("long")


def _mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str, text_col: str,
         key: Column, max_rate: float | None, whole: str | None = None, **limits) -> DataFrame:
    """:func:`mix` with ``key`` in place of the id; it decides the copies."""
    labelled = labels.select(F.col("doc_id").alias("id"), label_domain().alias("domain"))
    model = fit_domains(docs, labelled, id_col, text_col, tuple(targets), **limits)
    digest = F.xxhash64(text_or_empty(text_col), F.lit(3))
    keyed = docs.select(F.struct(key.alias("key"), digest.alias("digest")).alias("id"),
                        F.col(text_col).alias("text"))
    rows = fit_rates(posteriors(keyed, model, "id", "text", tuple(targets)), targets,
                     max_rate=max_rate, whole=whole)
    return rows.select(F.col("id.key").alias("doc_id"), "n_tokens", *[f"p_{d}" for d in targets],
                       "rate", copies_of("id", "rate").alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None,
        id_col: str = "doc_id", text_col: str = "text", max_rate: float | None = None,
        **limits) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate, copies`` per document."""
    return _mix(docs, labels, dict(targets or TARGETS), id_col, text_col, F.col(id_col),
                max_rate, **limits)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None,
          id_col: str = "doc_id", text_col: str = "text", whole: str | None = "clean",
          **limits) -> DataFrame:
    """``docs`` without those that the mix gives no copy, each at most once (rates of at most
    one), columns unchanged. The budget is at least what takes all of the domain ``whole`` (if
    it has a target), so that only the others are thinned to reach the targets. Ids may be null or repeat: a row is told by its id and text."""
    from docweave.llm.common import fresh, keep_rows, row_key
    name = fresh(docs, "_llm_keep")
    key = row_key(F.col(id_col), F.sha2(F.col(text_col), 256))
    targets = dict(targets or TARGETS)
    found = _mix(docs, labels, targets, id_col, text_col, key, 1.0,
                 whole if whole in targets else None, **limits)
    return keep_rows(docs, found.where("copies > 0").select(F.col("doc_id").alias(name)), key, name)
