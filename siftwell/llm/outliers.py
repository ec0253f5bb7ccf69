"""Quality rules with robust multivariate outliers: minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_runs, hash_windows, pieces, text_bytes, words, written

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Names of the transformed statistics, and the spread that a difference must exceed to say anything: it is
#: squared and added to each variance, so that a statistic that is the same in most texts (no symbol at all)
#: doesn't make the determinant zero.
AXES = ["length", "word_length", "symbols", "dup_lines", "repeats"]
RESOLUTION = (1.0, 0.03, 0.08, 0.12, 0.12)
#: Axes are kept as whole numbers of this fraction, so that sums are exact and the same in any order of rows.
UNIT = 1024
P = len(AXES)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def base_statistics(column: pa.Array) -> list[np.ndarray]:
    """STATISTICS of each text; a null has none of anything."""
    data, at = text_bytes(column)
    n = len(column)
    starts, ends, counts = words(data, at)
    total = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    of = np.repeat(np.arange(n), counts)
    chars = np.bincount(of, weights=total[ends] - total[starts], minlength=n).astype(np.int64)
    symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[at])
    n_lines, dup_lines = _lines(data, at, starts, n)
    return [counts.astype(np.int64), chars, symbols.astype(np.int64), n_lines, dup_lines, _repeats(hash_runs(data, starts, ends), of, n)]


def _lines(data: np.ndarray, at: np.ndarray, word_starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many lines with a word each text has, and how many of them equal an earlier one of it."""
    newline = data == 10
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at] = True
    begins = ~newline
    begins[1:] &= newline[:-1] | cut[1:-1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(np.append(newline, True) | cut)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    holds = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[holds], ends[holds]
    of = np.searchsorted(at, starts, side="right") - 1
    h = hash_runs(data, starts, ends)
    order = np.lexsort((h, of))
    h, by = h[order], of[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (by[1:] == by[:-1])
    return np.bincount(of, minlength=n), np.bincount(by[again], minlength=n)


def _repeats(h: np.ndarray, of: np.ndarray, n: int, k: int = 5) -> np.ndarray:
    """How many words of each text lie in windows of k words that it holds twice or more."""
    if len(h) < k:
        return np.zeros(n, dtype=np.int64)
    window = hash_windows(h, k)
    inside = np.flatnonzero(of[: len(window)] == of[k - 1 :])
    order = inside[np.lexsort((window[inside], of[inside]))]
    same = (window[order][1:] == window[order][:-1]) & (of[order][1:] == of[order][:-1])
    several = np.zeros(len(order), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    step = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(step, order[several], 1)
    np.add.at(step, order[several] + k, -1)
    return np.bincount(of[np.cumsum(step)[:-1] > 0], minlength=n)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch, "text"):
            if some.num_rows:
                kept = [x for x in some.schema.names if x != "text"]
                found = base_statistics(some.column(some.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(x)) for x in kept), *map(pa.array, found)], names=[*kept, *STATISTICS])


def statistics(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, STATISTICS...) of every whole text; a null text has no words."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in STATISTICS))


def axes() -> list[Column]:
    """The transformed statistics, as whole numbers of 1 / UNIT.

    The logarithm of the length; the logarithm of the mean word length; roots of the shares of symbols, repeated
    lines and repeated words, as roots of counts have about the same variance at any count. A share is taken
    over a few more words or lines than there are, and a word length as if 50 words of 5 characters came with
    the text, so that few words can't say much.
    """
    n = F.col("n_words")
    found = [F.log(n + 10.0), F.log((F.col("word_chars") + 250.0) / (n + 50.0)), F.sqrt(F.least(F.col("n_symbols") / (n + 50.0), F.lit(9.0))), F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10.0)), F.sqrt(F.col("n_repeat_words") / (n + 50.0))]
    return [F.round(x * UNIT).cast("long").alias(a) for x, a in zip(found, AXES, strict=True)]


def chi2_cdf(x: float, k: int) -> float:
    """The chance that a sum of k squared standard normals is at most x."""
    if x <= 0:
        return 0.0
    half = x / 2
    term, total = (math.exp(-half), 1 - math.exp(-half)) if k % 2 == 0 else (math.sqrt(2 * x / math.pi) * math.exp(-half), math.erf(math.sqrt(half)))
    for i in range(2 if k % 2 == 0 else 1, k, 2):
        term = term * half / (i / 2) if k % 2 == 0 else (term if i == 1 else term * x / i)
        total -= term
    return total


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, k) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What the covariance of the innermost share of normal rows must be multiplied by to be that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2) if share < 1 else 1.0


def _distance(values: list[Column], centre: str = "centre", whiten: str = "whiten") -> Column:
    """Squared Mahalanobis distance: the differences times the inverse of the covariance's Cholesky factor, squared and summed."""
    gap = [x / UNIT - F.col(centre)[i] for i, x in enumerate(values)]
    total = F.lit(0.0)
    for i in range(P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + gap[j] * F.col(whiten)[i * (i + 1) // 2 + j]
        total = total + part * part
    return total


def _packed(centre: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    """Centre, lower triangle of the whitening matrix, and log determinant, of a covariance with the resolution added."""
    chol = np.linalg.cholesky(cov + np.diag(np.square(RESOLUTION)))
    inverse = np.linalg.inv(chol)
    return centre.tolist(), [float(inverse[i, j]) for i, j in _PAIRS], float(2 * np.log(np.diag(chol)).sum())


def _moments(n: np.ndarray, one: np.ndarray, two: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums by bin, each bin counting with its weight."""
    total = float((n * weight).sum())
    mean = weight @ one / total
    cov = np.zeros((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = weight @ two[:, k] / total - mean[i] * mean[j]
    return mean, cov


_PLACE = "cell string, start int"
_ESTIMATE = f"{_PLACE}, centre array<double>, whiten array<double>, log_det double"


def _sums() -> list[Column]:
    """What moments are made of: the number of rows, sums, and sums of products, all whole numbers."""
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"one{i}") for i, x in enumerate(AXES)], *[F.sum(F.col(AXES[i]) * F.col(AXES[j])).alias(f"two{k}") for k, (i, j) in enumerate(_PAIRS)]]


def _read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = rows["n"].to_numpy(dtype=float)
    one = rows[[f"one{i}" for i in range(P)]].to_numpy(dtype=float) / UNIT
    two = rows[[f"two{k}" for k in range(len(_PAIRS))]].to_numpy(dtype=float) / UNIT**2
    return n, one, two


def _concentrated(share: float, scale: float):
    """The estimate from the innermost share of a cell's rows: bins in order of distance, the last one in part."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        n, one, two = _read(rows)
        before = np.cumsum(n) - n
        weight = np.clip((share * n.sum() - before) / n, 0, 1)
        centre, whiten, log_det = _packed(*(lambda mean, cov: (mean, cov * scale))(*_moments(n, one, two, weight)))
        return pd.DataFrame({"cell": rows["cell"].iloc[:1].to_list(), "start": rows["start"].iloc[:1].to_list(), "centre": [centre], "whiten": [whiten], "log_det": [log_det]})

    return step


def _elemental(rows: pd.DataFrame) -> pd.DataFrame:
    """Starts of a cell: the classical estimate (0), and one from each P + 1 drawn vectors."""
    n, one, two = _read(rows[rows["draw"] < 0])
    mean, cov = _moments(n, one, two, np.ones(len(n)))
    out = [(0, *_packed(mean, cov))]
    drawn = rows[rows["draw"] >= 0].sort_values("draw")
    points = drawn[[f"one{i}" for i in range(P)]].to_numpy(dtype=float) / UNIT
    for k in range(len(points) // (P + 1)):
        some = points[k * (P + 1) : (k + 1) * (P + 1)]
        out.append((k + 1, *_packed(some.mean(axis=0), np.cov(some.T, bias=True))))
    return pd.DataFrame({"cell": [rows["cell"].iloc[0]] * len(out), **{x: [r[i] for r in out] for i, x in enumerate(("start", "centre", "whiten", "log_det"))}})


class _Steps:
    """Concentration steps over a table of vectors (cell, AXES), and the tables they write."""

    def __init__(self, vectors: DataFrame, held_cells: int, cells: int):
        self.vectors, self.paths = vectors, []
        self.held, self.salts = cells <= held_cells, 16

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        self.paths.append(path)
        return df

    def beside(self, rows: DataFrame, estimates: DataFrame) -> DataFrame:
        """Rows with the estimates of their cell: broadcast up to held_cells cells, else joined by cell and salt, as one
        source may hold a third of all rows."""
        if self.held:
            return rows.join(F.broadcast(estimates), "cell")
        dealt = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        salt = F.pmod(F.xxhash64(*AXES), F.lit(self.salts)).cast("int")
        return rows.withColumn("salt", salt).join(dealt, ["cell", "salt"]).drop("salt")

    def step(self, estimates: DataFrame, share: float, scale: float, within: float | None = None) -> DataFrame:
        """The next estimate of each (cell, start); with `within`, from all rows of at most that squared distance."""
        met = self.beside(self.vectors, estimates).withColumn("d2", _distance([F.col(x) for x in AXES]))
        if within is not None:
            met = met.where(F.col("d2") <= within)
        # bins of a quarter octave of squared distance, so that a cell's rows are told by a few sums
        bins = F.floor(F.log2(F.greatest("d2", F.lit(2.0**-12))) * 4).cast("int")
        sums = met.groupBy("cell", "start", bins.alias("bin")).agg(*_sums())
        return self.keep(sums.groupBy("cell", "start").applyInPandas(_concentrated(share, scale), _ESTIMATE), "outlier-estimates")


def _best(estimates: DataFrame, k: int) -> DataFrame:
    """The k starts of least determinant of each cell; a cell has few starts."""
    ranked = estimates.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("log_det", "start", "centre", "whiten"))), 1, k).alias("s"))
    return ranked.select("cell", F.explode("s").alias("s")).select("cell", "s.start", "s.centre", "s.whiten", "s.log_det")


def estimate(rows: DataFrame, starts: int = 12, share: float = 0.6, most_steps: int = 12, held_cells: int = 20_000) -> tuple[DataFrame, str]:
    """A written table (cell, centre, whiten, log_det), and its path: minimum-covariance-determinant estimates of (cell, AXES).

    For each cell: the rows' own covariance and `starts` ones of P + 1 vectors drawn by hash; two concentration
    steps from each (the share of rows nearest to the last estimate makes the next one), the best two of these
    until no determinant falls by more than 1e-4; the least determinant; and one reweighting by all rows within
    its 0.975 quantile. All steps read all rows. Vectors that are the same are one: copies of one text, a third
    of a source it may be, would else be the tightest set there is.
    """
    vectors = rows.select("cell", *AXES).distinct()
    vectors, path = written(vectors, "outlier-vectors")
    cells = vectors.agg(F.approx_count_distinct("cell")).first()[0]
    run = _Steps(vectors, held_cells, cells)
    run.paths.append(path)
    draw = F.pmod(F.xxhash64(*AXES), F.lit(starts * (P + 1))).cast("int")
    order = F.struct(F.xxhash64(F.lit(1), *AXES), *AXES)
    drawn = vectors.groupBy("cell", draw.alias("draw")).agg(F.min_by(F.struct(*AXES), order).alias("v"))
    names = ["cell", "draw", "n", *[f"one{i}" for i in range(P)], *[f"two{k}" for k in range(len(_PAIRS))]]
    points = drawn.select("cell", "draw", F.lit(1).cast("long"), *[F.col("v")[x] for x in AXES], *[F.lit(0).cast("long") for _ in _PAIRS]).toDF(*names)
    all_rows = vectors.groupBy("cell").agg(*_sums()).withColumn("draw", F.lit(-1)).select(*names)
    now = run.keep(points.unionByName(all_rows).groupBy("cell").applyInPandas(_elemental, _ESTIMATE), "outlier-starts")
    scale = consistency(share)
    for _ in range(2):
        now = run.step(now, share, scale)
    now = run.keep(_best(now, 2), "outlier-estimates")
    for _ in range(most_steps):
        after = run.step(now, share, scale)
        fell = after.join(now.select("cell", "start", F.col("log_det").alias("was")), ["cell", "start"]).agg(F.max(F.col("was") - F.col("log_det"))).first()[0]
        now = after
        if fell is None or fell < 1e-4:
            break
    now = run.keep(_best(now, 1), "outlier-estimates")
    out, path = written(run.step(now, 1.0, consistency(0.975), chi2_quantile(0.975, P)).drop("start"), "outlier-final")
    discard(rows.sparkSession, *run.paths)
    return out, path


def with_cells(found: DataFrame, least_rows: int = 100) -> tuple[DataFrame, list[str]]:
    """statistics() with its `cell`, and the tables to discard after use.

    A cell is a language and source; sources with fewer than `least_rows` texts of a language are one cell of
    that language, languages with too few in such a cell are one cell, and where even that is too small, null."""
    worded = F.col("n_words") > 0
    by_source, path = written(found.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(F.count_if(worded).alias("n")).withColumn("own", F.col("n") >= least_rows), "outlier-sources")
    rest = by_source.where("not own").groupBy(F.col("_lang").alias("_rest")).agg(F.sum("n").alias("n_lang"))
    last = rest.where(F.col("n_lang") < least_rows).agg(F.sum("n_lang").alias("n_all"))
    n_all = last.first()[0] or 0
    placed = by_source.join(rest, F.col("_lang").eqNullSafe(F.col("_rest")), "left")
    own, of_lang = (F.to_json(F.struct(*[F.col(f"_{x}").alias(x) for x in names])) for names in (("lang", "source"), ("lang",)))
    cell = F.when(F.col("own"), F.concat(F.lit("source "), own)).when(F.col("n_lang") >= least_rows, F.concat(F.lit("language "), of_lang)).when(F.lit(n_all >= least_rows), F.lit("all"))
    names, cells_path = written(placed.select("_lang", "_source", cell.alias("cell")), "outlier-cells")
    # AQE broadcasts the cells where they are few, and splits a hot source where they are not
    out = found.join(names, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").select(*found.columns, "cell")
    return out, [path, cells_path]


def judge(docs: DataFrame, confidence: float = 0.9999, least_rows: int = 100, held_cells: int = 20_000, **columns: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, cell) for every row.

    A text fails the base rule with fewer than 10 words or more than a fifth of them in repeated windows. Another
    one is kept unless its squared Mahalanobis distance from its cell's estimate exceeds the chi-square quantile
    of `confidence`. All texts with a word are in the estimates. A null or empty text has no words and fails; a
    null language or source is one of its own; where no cell is large enough, the base rule alone decides.
    Repeated rows share their fate, and an empty table gives no rows.
    """
    measured, path = written(statistics(docs, **columns), "outlier-statistics")
    placed, gone = with_cells(measured, least_rows)
    found, rows_path = written(placed.select("doc_id", *STATISTICS, "cell", *axes()), "outlier-rows")
    discard(docs.sparkSession, path, *gone)
    estimates, *estimate_path = estimate(found.where("n_words > 0 AND cell IS NOT NULL"), held_cells=held_cells)
    few = estimates.count() <= held_cells
    salt = F.pmod(F.xxhash64(*AXES), F.lit(1 if few else 16)).cast("int")
    dealt = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(0 if few else 15))))
    met = found.withColumn("salt", salt).join(F.broadcast(dealt) if few else dealt, ["cell", "salt"], "left")
    distance = F.when(F.col("centre").isNotNull(), _distance([F.col(x) for x in AXES]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~base & (F.coalesce(distance, F.lit(0.0)) <= chi2_quantile(confidence, P))
    out, _ = written(met.select("doc_id", *[x for x in STATISTICS if x != "n_lines"], base.alias("base_failed"), kept.alias("kept"), distance.alias("distance"), "cell"), "outlier-verdicts")
    discard(docs.sparkSession, rows_path, *estimate_path)
    return out
