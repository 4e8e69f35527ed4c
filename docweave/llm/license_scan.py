"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

Words are lower-case runs of letters and digits; shingles are five words, kept as 64-bit
hashes. Templates are put in classes of at most 1, 8, 64, 512, ... shingles. For a class of
size L a text is read through windows of 3L/2 shingles, L/2 apart, so that any run of L
shingles lies inside a window. A window's MinHash sketch has one hash per shingle and
``BINS`` bins, each band being the least hash of one bin; a template is retrieved for a
window that shares a band with it. For a window with similarity J to a template a band
collides with probability J, so a template of more than L/8 shingles of which 0.8 are
present is missed with a probability below (1 - J)^b for its b non-empty bins: 0.02 at
the least favourable size. Other shingles of the window can hold a bin's least hash, so some
more are missed: simulated with one window at containment 0.8, 0.0004 of templates of 3
shingles, 0.002 of 9 (the worst of the sizes tried up to 15) and 0.010 of 65. Retrieved templates
are verified exactly: the share of the template's distinct shingles that the window holds
must reach ``min_containment``.

Everything up to the retrieved pairs happens in the text's own row; band keys are first
tested against a constant bit table of the template bands (which can only pass too many), so
few rows meet the template table. That table is broadcast; its size is checked against
``MAX_TEMPLATE_SHINGLES``.

Defined results: null and empty texts match nothing; texts of fewer than five words and
templates of fewer than five words have the one shingle of all their words; a null or empty
template never matches; repeated rows give repeated matches; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import let, text_or_empty
from docweave.llm.license_texts import LICENSES

SHINGLE = 5
BIN_BITS = 6
BINS = 1 << BIN_BITS
MIN_CONTAINMENT = 0.8
MAX_TEMPLATE_SHINGLES = 50_000
TABLE_BITS = 20          # some thousand bands set a bit of 10^6: few windows are listed by chance

# Short public notices (fixed values); :mod:`license_texts` has texts and headers of licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text"))
                     for n, t in (*TEMPLATES, *LICENSES)])
    return spark.range(1).select(F.inline(rows))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of the 5-word shingles of a word array, in order (fewer words: of all)."""
    def hashes(w: Column) -> Column:
        few = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.array(F.xxhash64(F.concat_ws(" ", w))))
        many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(
            *[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(w) < SHINGLE, few).otherwise(many)

    return let(words, hashes)


def bands_of(hashes: Column) -> Column:
    """The least hash of each non-empty bin (bins are the leading bits of the hash)."""
    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | F.coalesce(
            F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(s, i - 1), 64 - BIN_BITS), F.lit(True)))

    return let(F.sort_array(hashes), firsts)


def size_class(n: int) -> int:
    """The class, a power of eight, of a template of ``n`` distinct shingles."""
    size = 1
    while size < n:
        size *= 8
    return size


def windows_of(hashes: Column, size: int) -> Column:
    """Arrays of shingle hashes: every run of ``size`` shingles is inside one of them."""
    step, width = max(1, size // 2), size + size // 2
    last = F.greatest(F.lit(0), F.ceil((F.size(hashes) - width) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(hashes, i * step + 1, width))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).cast("int")


def _bit_table(bands: set[int]) -> Column:
    """Constant table with a bit set for each band, addressed by its low bits."""
    bits = [0] * ((1 << TABLE_BITS) // 32)
    for b in bands:
        at = b & ((1 << TABLE_BITS) - 1)
        bits[at >> 5] |= 1 << (at & 31)
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def _listed(bands: Column, table: Column) -> Column:
    """Bands whose bit is set in the table."""
    return F.filter(bands, lambda x: F.getbit(
        F.get(table, F.shiftright(_place(x), 5)), _place(x).bitwiseAND(F.lit(31))) == 1)


def license_scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment`` (of the best window) for every template a text
    contains. ``templates`` has ``license`` and ``text``."""
    known = (templates.where("text IS NOT NULL")
             .select("license", F.array_distinct(shingles_of(words_of(F.col("text")))).alias("want"))
             .where(F.size("want") > 0).select("license", "want", bands_of(F.col("want")).alias("bands")))
    local = known.collect()
    if sum(len(r.want) for r in local) > MAX_TEMPLATE_SHINGLES:
        raise ValueError("too many template shingles to broadcast")
    table = _bit_table({b for r in local for b in r.bands})

    def sketched(windows: Column) -> Column:
        """Windows with a listed band, and those bands."""
        pairs = F.transform(windows, lambda w: F.struct(
            w.alias("w"), _listed(bands_of(w), table).alias("bands")))
        return F.filter(pairs, lambda p: F.size(p["bands"]) > 0)

    def single(hashes: Column) -> Column:
        """The same for windows of one shingle, whose only band it is."""
        return F.transform(_listed(hashes, table), lambda x: F.struct(
            F.array(x).alias("w"), F.array(x).alias("bands")))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       shingles_of(words_of(text_or_empty(text_col))).alias("h"))
    h = F.col("h")
    least: dict[int, int] = {1: 1}                      # shingles that a match of a class needs
    for r in local:
        size = size_class(len(r.want))
        least[size] = min(least.get(size, size), math.ceil(min_containment * len(r.want)))

    def of_class(size: int) -> Column:
        """Listed windows of a class; none in a text too short to hold enough of a template."""
        windows = F.when(F.size(h) >= least[size], windows_of(h, size)).otherwise(
            F.array().cast("array<array<bigint>>"))
        return single(h) if size == 1 else sketched(windows)

    rows = rows.select("doc_id", "row", F.explode(F.concat(*map(of_class, sorted(least)))).alias("x"))
    pairs = known.select("license", "want", F.explode("bands").alias("band"))
    return (rows.select("doc_id", "row", "x.w", F.explode("x.bands").alias("band"))
            .join(F.broadcast(pairs), "band")
            .withColumn("containment", F.size(F.array_intersect("want", "w")) / F.size("want"))
            .where(F.col("containment") >= min_containment)
            .groupBy("doc_id", "row", "license").agg(F.max("containment").alias("containment"))
            .select("doc_id", "license", "containment"))
