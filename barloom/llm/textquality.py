"""Statistics of document text, and what kind of text they speak of (problem 10).

One pass over the texts leaves a narrow table of statistics. A Gaussian mixture is fitted to all of its rows by
expectation-maximisation: each step sums one small matrix over the cluster. Each component begins at one inspected
example text and takes its kind; the example stays in the fit with the weight of a small share of the documents, so that
kinds which few documents have aren't swallowed by others. A component of prose clears the documents inside the
ellipsoid around its mean that lies wholly within given limits; only the others need the limits' exact check.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import alphanumeric, blank, code_points
from barloom.sources.tables import written

STATISTICS = ("mean_word_length", "symbol_ratio", "line_end_share", "common_share", "log_words")
#: The characters that end a line of prose.
LINE_ENDS = ".!?:;…\"”»)"

#: Inspected examples, each with the kind of text a reader takes it for; one component of the mixture each.
EXAMPLES = (
    ("prose", "The court heard the appeal on the first of May. It was said that the lease had been signed by the agent,\nand that the tenant had paid the rent to him. We do not accept that this is so.\n"),
    ("prose", "Das Gericht hat die Klage abgewiesen, weil der Vertrag nicht wirksam war.\nDie Berufung ist zulässig, aber nicht begründet.\n"),
    ("prose", "The parties were agreed that the charter had come to an end by the time the goods were\nput on board, and the only question for us is which of them must bear the loss that came\nof the delay. The judge below thought it was the owner. In our view he was right, for the\nreasons that he gave and for one more.\n"),
    ("list", "Items received\nledger, bound\nsealed envelope\nthree keys\nmap of the harbour\nwitness statement A\nwitness statement B\nschedule of rents\n"),
    ("list", "Letter of the agent to the owner of the mill\nReply by the owner to the second letter\nNotice of the sale of the goods in the warehouse\nOrder for the return of the deposit\nList of the witnesses for the defence\n"),
    ("list", "Duties of the clerk, 3\nForms of oath, 14\nGeneral index, 220\nHours of sitting, 7\nOaths and declarations, 15\nTable of fees, 31\n"),
    ("table", "2019 | 1,204.50 | 33.1 % | ---\n2020 | 1,377.25 | 35.9 % | +2.8\n2021 | 1,102.00 | 29.4 % | -6.5\n2022 | 1,518.75 | 40.2 % | +10.8\n"),
    ("table", "+-----+------+\n| no. | sum  |\n+-----+------+\n| 1   | 4.20 |\n| 2   | 7.75 |\n+-----+------+\n"),
    ("table", "flour  white  12.40  Norwich  3%\nsugar  brown  9.85  Bristol  11%\nbarley  malted  30.10  Exeter  7%\ncoffee  roasted  48.00  Hull  5%\n"),
    ("table", "flour;white;12.40;Norwich;3%\nsugar;brown;9.85;Bristol;11%\nbarley;malted;30.10;Exeter;7%\ncoffee;roasted;48.00;Hull;5%\n"),
    ("table", "Preface ................ 3\nFirst part ........................ 17\nSecond part ................. 164\nNotes .......................... 301\nSources ............................ 340\n"),
    ("table", "<tr><td>flour</td><td>12.40</td></tr>\n<tr><td>brown sugar</td><td>9.85</td></tr>\n<tr><td>malted barley</td><td>30.10</td></tr>\n"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgdGV4dA==QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo= ZmZmZmZmZmZmZmZmZmZmZmZmZmZmZmZm c2RmZ2hqa2xxd2VydHl1aW9w\n"),
    ("junk", "#@!%&*() <<>>~~^^ ==//\\\\|| {}[] $$$ ### @@@ !!! %%% &&& *** ((( ))) ___ +++\n"),
    ("junk", "q7# kd;w 0z{ p,x9 ~vv 3]b l&m t=8 [y r%j4 h:u n^c e'2 ?s5 g!o a@i6\nx1} w_w ,z 9k| o+b4 ;r m/d 7$t v<c .q\n"),
    ("junk", "of it and the with that by on from as the was but not\nto in which for at the is of and or had been so they a to it\nthe and in of by that with as from on at is was for\n"),
)
#: The weight of an example in the fit, as a share of the documents with words.
ANCHOR = 0.002
#: The variance of an example, in standardised statistics.
SPREAD = 0.3


class _Common(dict):
    """Word as written -> whether it is common; filled as words come, emptied when it grows too large."""

    def __init__(self, words: frozenset[str], most: int = 500_000) -> None:
        self.words, self.most = words, most

    def __missing__(self, word: str) -> bool:
        if len(self) >= self.most:
            self.clear()
        a, b = 0, len(low := word.lower())
        while a < b and not low[a].isalpha():
            a += 1
        while b > a and not low[b - 1].isalpha():
            b -= 1
        self[word] = out = low[a:b] in self.words
        return out


def measure(texts: list[str | None], common: _Common) -> dict[str, list]:
    """n_words, n_lines and the statistics of each text; those of a text without words (or null) are None, but counts 0.

    n_chars is None for a null text. A text without lines has no words.
    """
    ends = frozenset(LINE_ENDS)
    out: dict[str, list] = {k: [] for k in ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "line_end_share", "common_share")}
    letters, white = alphanumeric(), blank()
    for text in texts:
        words = text.split() if text else []
        out["n_chars"].append(None if text is None else len(text))
        out["n_words"].append(len(words))
        if not words:
            out["n_lines"].append(0)
            for k in ("mean_word_length", "symbol_ratio", "line_end_share", "common_share"):
                out[k].append(None)
            continue
        n = len(words)
        solid = sum(map(len, words))
        if text.isascii():
            cp = np.frombuffer(text.encode(), np.uint8)
        else:
            cp = code_points(text)
        symbols = len(cp) - int(np.count_nonzero(letters[cp] | white[cp]))
        lines = [s for s in map(str.rstrip, text.replace("\f", "\n").split("\n")) if s]
        out["n_lines"].append(len(lines))
        out["mean_word_length"].append(solid / n)
        out["symbol_ratio"].append(symbols / solid)
        out["line_end_share"].append(sum(s[-1] in ends for s in lines) / len(lines))
        out["common_share"].append(sum(map(common.__getitem__, words)) / n)
    return out


def statistics(documents: DataFrame, id: str, text: str, common_words: DataFrame) -> DataFrame:
    """(id, n_chars, n_words, n_lines, mean_word_length, symbol_ratio, line_end_share, common_share) of each document.

    Words are split at white space; mean_word_length is in characters; symbol_ratio is the share of characters that
    aren't white space that are neither letters nor digits; lines are split at line and page feeds, blank ones don't
    count, and one ends in punctuation if its last character that isn't white is one of LINE_ENDS; common_share is that
    of words that, in lower case and without what isn't a letter at both ends, are a `word` of common_words. Without
    words the last four are null and the counts 0; n_chars of a null text is null. common_words is brought to the
    driver after a check that it has at most 100,000 rows. Other columns are ignored; an empty table gives none.
    """
    words = [r[0] for r in common_words.select("word").where("word is not null").distinct().limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("common_words has more than 100,000 words")
    fixed = frozenset(w.lower() for w in words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Common(fixed)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = measure(batch.column(1).to_pylist(), memo)
                kinds = {"n_chars": pa.int64(), "n_words": pa.int64(), "n_lines": pa.int64()}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(v, kinds.get(k, pa.float64())) for k, v in found.items())], ["id", *found]
                )

    narrow = documents.select(F.col(f"`{id}`").cast("bigint"), F.col(f"`{text}`"))
    schema = "id long, n_chars long, n_words long, n_lines long, mean_word_length double, symbol_ratio double, line_end_share double, common_share double"
    return narrow.mapInArrow(rows, schema)


@dataclass
class Mixture:
    """A fitted mixture over standardised statistics; labels name the components."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    labels: tuple[str, ...]
    steps: int
    objective: float

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances of standardised rows to each component."""
        out = np.empty((len(x), len(self.means)))
        for k, (m, c) in enumerate(zip(self.means, self.covariances)):
            z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
            out[:, k] = (z * z).sum(0)
        return out

    def coefficients(self) -> np.ndarray:
        """Of the log densities as sums over `_squares` of a standardised row, a column for each component."""
        d = self.means.shape[1]
        inverse = np.linalg.inv(self.covariances)
        linear = np.einsum("kij,kj->ki", inverse, self.means)
        constant = np.log(self.weights) - 0.5 * (np.einsum("ki,ki->k", linear, self.means) + np.linalg.slogdet(self.covariances)[1] + d * np.log(2 * np.pi))
        i, j = np.triu_indices(d)
        return np.column_stack([constant, linear, -0.5 * np.where(i == j, 1, 2) * inverse[:, i, j]]).T


def _squares(x: np.ndarray) -> np.ndarray:
    """1, the values of each row, and their products with one another."""
    i, j = np.triu_indices(x.shape[1])
    return np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]])


def _rows(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of STATISTICS from the statistics' columns and the number of words."""
    *plain, n_words = columns
    return np.column_stack([*plain, np.log1p(n_words)]).astype(float)


_FEATURES = ("mean_word_length", "symbol_ratio", "line_end_share", "common_share", "n_words")


def _examples(common: frozenset[str]) -> tuple[np.ndarray, list[str]]:
    found = measure([t for _, t in EXAMPLES], _Common(common))
    return _rows([np.array(found[c], float) for c in _FEATURES]), [k for k, _ in EXAMPLES]


def fit(measured: DataFrame, common: frozenset[str], most_steps: int = 20, tolerance: float = 1e-3, ridge: float = 1e-3) -> Mixture | None:
    """The mixture over all rows of `measured` (a table from `statistics`) that have words; None if there are none.

    The 16 examples, of the length of the mean document, count as ANCHOR of all rows each, with variance SPREAD, for
    their own component. One action for the scale of the statistics and one for each step of at most most_steps, each
    returning one matrix, summed on the executors. Ends when the objective (log-likelihood of rows and examples, by row)
    gains less than `tolerance`.
    """
    rows = measured.where("n_words > 0").select(*_FEATURES)
    real = [F.col(c) for c in _FEATURES[:-1]] + [F.log1p("n_words")]
    one = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in real], *[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in real]).first()
    n = one[0]
    if not n:
        return None
    d = len(STATISTICS)
    centre, scale = np.array(one[1 : d + 1]), np.array(one[d + 1 :])
    scale = np.where(scale > 1e-9, scale, 1.0)
    points, names = _examples(common)
    points = (points - centre) / scale
    points[:, STATISTICS.index("log_words")] = 0
    k = len(names)
    anchor = ANCHOR * n
    model = Mixture(centre, scale, np.full(k, 1 / k), points, np.array([np.eye(d) * SPREAD] * k), tuple(names), 0, -np.inf)
    i, j = np.triu_indices(d)
    width = 1 + d + len(i)
    for step in range(1, most_steps + 1):
        sent = model.coefficients()

        def sums(batches: Iterator[pa.RecordBatch], sent: np.ndarray = sent) -> Iterator[pa.RecordBatch]:
            total, likelihood = np.zeros((k, width)), 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _squares((_rows([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre) / scale)
                logs = x @ sent
                top = logs.max(1)
                part = np.exp(logs - top[:, None])
                norm = part.sum(1)
                part /= norm[:, None]
                likelihood += float((top + np.log(norm)).sum())
                total += part.T @ x
            values = np.append(total.ravel(), likelihood)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.float64())], ["place", "value"])

        got = rows.mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value")).collect()
        values = np.zeros(k * width + 1)
        for place, value in got:
            values[place] = value
        own = _squares(points)
        own[:, 1 + d :] += SPREAD * (i == j)
        objective = (values[-1] + anchor * float((own.T * sent).sum())) / n
        total = values[:-1].reshape(k, width) + anchor * own
        mass = total[:, 0]
        means = total[:, 1 : 1 + d] / mass[:, None]
        covariances = np.zeros((k, d, d))
        covariances[:, i, j] = covariances[:, j, i] = total[:, 1 + d :] / mass[:, None] - means[:, i] * means[:, j]
        gained = objective - model.objective
        model = Mixture(centre, scale, mass / mass.sum(), means, covariances + ridge * np.eye(d), tuple(names), step, objective)
        if gained < tolerance:
            break
    return model


def cleared_radius(model: Mixture, limits: Mapping[str, tuple[float, float]]) -> np.ndarray:
    """For each component the squared radius within which every row meets the limits (least and greatest value of a
    statistic); 0 for components not named prose, and for those whose mean breaks a limit.

    The ellipsoid of radius r reaches r times the component's own deviation along each statistic.
    """
    out = np.zeros(len(model.means))
    for k, (mean, cov, label) in enumerate(zip(model.means, model.covariances, model.labels)):
        if label != "prose":
            continue
        radius = np.inf
        for name, (low, high) in limits.items():
            j = STATISTICS.index(name)
            deviation = np.sqrt(cov[j, j])
            bounds = ((low - model.centre[j]) / model.scale[j], (high - model.centre[j]) / model.scale[j])
            radius = min(radius, (mean[j] - bounds[0]) / deviation, (bounds[1] - mean[j]) / deviation)
        out[k] = max(0.0, radius) ** 2 * (1 - 1e-9) if np.isfinite(radius) else 0.0
    return out


def judged(documents: DataFrame, id: str, text: str, common_words: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """The statistics of each document with `kind` (prose, list, table or junk: that of the likeliest component; `empty`
    without words) and `cleared` (inside a prose component's ellipsoid that lies within the limits).

    A document that breaks a limit is never cleared. The statistics are written to the shared folder once. See
    `statistics` for nulls and other cases.
    """
    measured = written(statistics(documents, id, text, common_words), "textquality")
    fixed = frozenset(r[0].lower() for r in common_words.select("word").where("word is not null").distinct().collect())
    model = fit(measured, fixed)
    names = measured.columns
    radius = cleared_radius(model, limits) if model else None
    coefficients = model.coefficients() if model else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.full(batch.num_rows, "empty", object)
            cleared = np.zeros(batch.num_rows, bool)
            has = batch.column(names.index("n_words")).to_numpy(zero_copy_only=False) > 0
            if model and has.any():
                own = batch.filter(pa.array(has))
                x = (_rows([own.column(names.index(c)).to_numpy(zero_copy_only=False) for c in _FEATURES]) - model.centre) / model.scale
                kind[has] = np.array(model.labels, object)[(_squares(x) @ coefficients).argmax(1)]
                cleared[has] = (model.distances(x) < radius).any(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind.tolist(), pa.string()), pa.array(cleared, pa.bool_())], [*names, "kind", "cleared"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema.fields) + ", kind string, cleared boolean"
    return measured.mapInArrow(rows, schema).withColumnRenamed("id", id)


def breaks(limits: Mapping[str, tuple[float, float]]) -> Column:
    """Whether a row of statistics breaks a limit."""
    out: Column = F.lit(False)
    for name, (low, high) in limits.items():
        out = out | (F.col(name) < low) | (F.col(name) > high)
    return out
