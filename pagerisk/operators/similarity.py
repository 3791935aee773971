"""Vector operators: text encoding, mean vectors, cosine, nearest headline."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pagerisk.functions.encoders import Encoder, encode_distinct, text_vector, total_text_vector
from pagerisk.functions.text import cosine01
from pagerisk.operators.blocks import BROADCAST_BYTES, CELL_ROWS, compare_in_cells
from pagerisk.operators.pages import extract, flat_headings
from pagerisk.operators.urls import normalize_url, url_components
from pagerisk.session import materialise

URL_MATCH_THRESHOLD = 0.80
PROPERTY_THRESHOLD = 0.75
_NEAREST = "struct<sim:double,label:int,idx:bigint>"
_NEAREST_ARROW = pa.struct([("sim", pa.float64()), ("label", pa.int32()), ("idx", pa.int64())])
_QUERIES_AT_ONCE, _ROWS_AT_ONCE = 1024, 512


def embed_texts(
    df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", dedupe: bool = False
) -> DataFrame:
    """Add the vector of a text column; equal texts of a batch are encoded once.

    ``dedupe`` encodes equal texts of the whole table once and joins the vectors back, which
    pays for a costly encoder and many repeated texts.
    """
    if not dedupe:
        return df.withColumn(out, text_vector(F.col(text), encoder))
    distinct = df.select(text).filter(F.col(text).isNotNull()).distinct()
    vectors = distinct.withColumn(out, text_vector(F.col(text), encoder))
    return df.join(vectors, text, "left").select(*df.columns, out)


def mean_vector(df: DataFrame, by: list[str], vector: str, out: str = "mean") -> DataFrame:
    """Per-component mean over the vectors of a group.

    Components are averaged with partial aggregation, so a group of any size is fine; only
    the ``dim`` averages of a group are put together at the end.
    """
    parts = df.select(*by, F.posexplode(vector).alias("__pos", "__x"))
    means = parts.groupBy(*by, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__x"))
    packed = means.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__pos", "__x"))).alias(out))
    return packed.withColumn(out, F.col(out)["__x"])


def with_cosine01(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    return df.withColumn(out, cosine01(a, b))


def with_url_texts(df: DataFrame, url: str = "url", out: str = "url_texts") -> DataFrame:
    """Path, query and netloc of the normalised URL, empty ones included."""
    parts = url_components(normalize_url(df, url, "__norm"), "__norm", "__parts")
    texts = F.array("__parts.path", "__parts.query", "__parts.netloc")
    return parts.withColumn(out, texts).drop("__norm", "__parts")


def url_content_similarity(
    df: DataFrame,
    encoder: Encoder,
    url: str = "url",
    content: str = "content",
    threshold: float = URL_MATCH_THRESHOLD,
) -> DataFrame:
    """Add (similarity, match) of a URL and its content list; empty content gives (0.0, false)."""
    vectors = with_url_texts(df, url, "__texts").withColumns(
        {
            "__content": total_text_vector(F.col(content), encoder),
            "__url": total_text_vector(F.col("__texts"), encoder),
        }
    )
    similarity = F.coalesce(cosine01("__content", "__url"), F.lit(0.0))
    return (
        vectors.withColumn("similarity", similarity)
        .withColumn("match", F.col("similarity") >= threshold)
        .drop("__texts", "__content", "__url")
    )


def compare_encoders(
    pages: DataFrame,
    encoders: list[Encoder],
    threshold: float = URL_MATCH_THRESHOLD,
    preview: int | None = None,
) -> DataFrame:
    """One row (Model, URL, Similarity, Match) per encoder and page; pages are parsed once.

    ``preview`` keeps that many rows, the first by URL and model, for a look at the result.
    """
    parsed = extract(pages.select("url", "html"), ["title", "headings"])
    step = parsed.select("url", flat_headings().alias("content"))
    results = []
    for i, encoder in enumerate(encoders):
        step = url_content_similarity(step, encoder, threshold=threshold)
        step = step.withColumnsRenamed({"similarity": f"__s{i}", "match": f"__m{i}"})
        results.append(
            F.struct(
                F.lit(encoder.name).alias("Model"),
                F.col("url").alias("URL"),
                F.col(f"__s{i}").alias("Similarity"),
                F.col(f"__m{i}").alias("Match"),
            )
        )
    compared = step.select(F.inline(F.array(*results)))
    return compared if preview is None else compared.orderBy("URL", "Model").limit(preview)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The non-NULL vectors of a list array as rows."""
    known = vectors.drop_null()
    flat = known.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(known), -1 if len(known) else 0)


def _combined(column: pa.ChunkedArray) -> pa.Array:
    combined = column.combine_chunks()
    return pa.concat_arrays(combined.chunks) if isinstance(combined, pa.ChunkedArray) else combined


def _compact(vectors: np.ndarray) -> np.ndarray:
    """The same values in the smallest type that holds all of them exactly.

    Encoders that count need a quarter of the memory, which every Python worker takes.
    """
    for kind in (np.int16, np.float32):
        with np.errstate(over="ignore", invalid="ignore"):
            small = vectors.astype(kind)
        if np.array_equal(small, vectors):
            return small
    return vectors


class _Nearest:
    """Vectors in the order of their numbers, searched for the best of each query; exact.

    Products of unit vectors in single precision tell which rows come close to the best; those
    are computed again in double precision, row by row, which gives equal vectors equal
    similarities wherever they lie. Of equal vectors the first is kept. ``compact`` keeps them in
    the smallest exact type and makes units when they are needed.
    """

    def __init__(self, vectors: np.ndarray, numbers: np.ndarray, compact: bool = False):
        norms = np.sqrt((vectors**2).sum(axis=1))
        usable = np.flatnonzero(norms > 0)
        usable = usable[np.argsort(numbers[usable], kind="stable")]
        if len(usable):
            keys = np.ascontiguousarray(vectors[usable]).view(np.dtype((np.void, 8 * vectors.shape[1])))
            usable = usable[np.sort(np.unique(keys.ravel(), return_index=True)[1])]
        self.rows = usable
        self.vectors, self.norms = vectors[usable], norms[usable]
        self.units = None if compact else self._units(slice(None))
        if compact:
            self.vectors = _compact(self.vectors)

    def _units(self, rows: slice) -> np.ndarray:
        return (self.vectors[rows] / self.norms[rows, None]).astype(np.float32)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best similarity and the row it is found in, the first on ties; NaN without one."""
        sims, rows = np.full(len(queries), np.nan), np.zeros(len(queries), dtype=np.int64)
        norms = np.sqrt((queries**2).sum(axis=1))
        wanted = np.flatnonzero(norms > 0)
        if not len(self.rows):
            return sims, rows
        for start in range(0, len(wanted), _QUERIES_AT_ONCE):
            part = wanted[start : start + _QUERIES_AT_ONCE]
            sims[part], rows[part] = self._search(queries[part], norms[part])
        return sims, rows

    def _search(self, queries: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units = (queries / norms[:, None]).astype(np.float32)
        # Twice what a product of this many terms may be off by.
        spare = np.float32((queries.shape[1] + 8) * 2.0**-22)
        floor = np.full(len(queries), -2, np.float32)
        sims, best = np.full(len(queries), -1.0), np.full(len(queries), len(self.rows))
        for low in range(0, len(self.rows), _ROWS_AT_ONCE):
            some = slice(low, low + _ROWS_AT_ONCE)
            known = self._units(some) if self.units is None else self.units[some]
            cosines = units @ known.T
            top = cosines.max(axis=1)
            np.maximum(floor, top - spare, out=floor)
            hit = np.flatnonzero(top >= floor)
            which, columns = np.nonzero(cosines[hit] >= floor[hit, None])
            which, columns = hit[which], low + columns
            dots = (queries[which] * self.vectors[columns]).sum(axis=1)
            exact = (dots / (norms[which] * self.norms[columns]) + 1) / 2
            order = np.lexsort((columns, -exact, which))
            first = order[np.flatnonzero(np.diff(which[order], prepend=-1))]
            which, columns, exact = which[first], columns[first], exact[first]
            better = (exact > sims[which]) | (best[which] == len(self.rows))
            sims[which[better]], best[which[better]] = exact[better], columns[better]
        return sims, self.rows[best]


class _Headlines:
    """A block of corpus vectors in ``idx`` order, searched by matrix product."""

    def __init__(self, table: pa.Table):
        ordered = table.filter(pc.is_valid(table.column("embedding"))).sort_by("idx")
        self.idx = ordered.column("idx").to_numpy()
        self.labels = ordered.column("label").to_numpy()
        self.vectors = _Nearest(_matrix(_combined(ordered.column("embedding"))), self.idx, True)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best similarity and the row it is found in, the first on ties; NaN without one."""
        return self.vectors.search(queries)

    def as_structs(self, sims: np.ndarray, rows: np.ndarray) -> pa.StructArray:
        """(sim, label, idx) per query, NULL where nothing was found."""
        missing = np.isnan(sims)
        if not len(self.idx):
            return pa.nulls(len(sims), type=_NEAREST_ARROW)
        return pa.StructArray.from_arrays(
            [
                pa.array(sims, type=pa.float64()),
                pa.array(self.labels[rows].astype(np.int32)),
                pa.array(self.idx[rows].astype(np.int64)),
            ],
            fields=list(_NEAREST_ARROW),
            mask=pa.array(missing),
        )


def _at_valid(values: pa.Array, like: pa.Array) -> pa.Array:
    """Spread values of the non-NULL entries of ``like`` over all its entries."""
    if not like.null_count:
        return values
    places = np.cumsum(like.is_valid().to_numpy(zero_copy_only=False)) - 1
    return values.take(pa.array(places, mask=like.is_null().to_numpy(zero_copy_only=False)))


class HeadlineCorpus:
    """Encoded headlines (idx, embedding, label) and how they reach the tasks.

    Their size is known before they are used: up to ``broadcast_bytes`` the vectors are
    broadcast, beyond that contents meet the cells of the corpus that can hold their nearest.
    """

    def __init__(
        self,
        corpus: DataFrame,
        broadcast_bytes: int = BROADCAST_BYTES,
        size: tuple[int, int] | None = None,
    ):
        self.corpus = corpus.select(
            F.col("idx").cast("long").alias("idx"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.col("label").cast("int").alias("label"),
        )
        if size is None:
            size = self.corpus.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        self.rows, self.row_bytes = size[0], 8 * (size[1] or 1) + 16
        self.broadcast_bytes = broadcast_bytes
        self.small = self.rows * self.row_bytes <= broadcast_bytes
        self._shared = None

    def shared(self):
        """The broadcast block; only for a corpus within the size bound."""
        if not self.small:
            raise ValueError("the corpus exceeds the broadcast bound")
        if self._shared is None:
            block = _Headlines(self.corpus.toArrow())
            self._shared = self.corpus.sparkSession.sparkContext.broadcast(block)
        return self._shared


def read_corpus(
    headlines: DataFrame,
    encoder: Encoder,
    text: str = "headline",
    label: str = "clickbait",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> HeadlineCorpus:
    """Encode a labelled headline table (idx, text, label) once; its rows are counted before."""
    encoded = embed_texts(headlines, text, encoder)
    vectors = encoded.select("idx", "embedding", F.col(label).alias("label"))
    return HeadlineCorpus(vectors, broadcast_bytes, (headlines.count(), encoder.dim))


def nearest_headline(
    contents: DataFrame, corpus: HeadlineCorpus, key: str, vector: str = "embedding"
) -> DataFrame:
    """Add (sim, label, idx) of the most similar headline per content vector.

    ``key`` is unique in ``contents``. Only the best match of a content leaves a task.
    """
    if corpus.small:
        shared = corpus.shared()

        @F.arrow_udf(_NEAREST)
        def search(batch: pa.Array) -> pa.Array:
            block = shared.value
            return _at_valid(block.as_structs(*block.nearest(_matrix(batch))), batch)

        found = contents.withColumn("__best", search(F.col(vector)))
        return found.select(*contents.columns, "__best.*")

    usable = contents.select(key, F.col(vector).cast("array<double>").alias("vector"))
    best = nearest_in_cells(usable, corpus, key)
    return contents.join(best.drop("compared"), key, "left").select(
        *contents.columns, "sim", "label", "idx"
    )


#: Vectors that centres are fitted on, and the most centres.
_SAMPLE = 4096
_MOST_CENTRES = 1024
#: Angles are compared with this much to spare, far more than their rounding.
_SPARE = 1e-6


def nearest_in_cells(
    contents: DataFrame, corpus: HeadlineCorpus, key: str, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Rows (key, sim, label, idx, compared) of the usable vectors in ``contents``; exact.

    The corpus is cut into cells around centres, which are fitted on a bounded sample. A
    content is first compared within the cell of its own nearest centre. The best angle found
    there, and the triangle inequality of angles, tell which other cells can hold a nearer
    vector, and in each only the vectors whose angle to the centre leaves that open are
    compared. Contents without a direction have no row.
    """
    spark = contents.sparkSession
    # Vectors are written before they are asked for anything: a filter above their encoder, or
    # two columns of one, would have everything encoded again.
    known = materialise(corpus.corpus, "corpus-vectors").filter("embedding IS NOT NULL")
    centres = spark.sparkContext.broadcast(
        _centres(known, min(_MOST_CENTRES, max(1, int(corpus.rows**0.5))))
    )
    everywhere = np.ones(len(centres.value), bool)
    placed = known.withColumn("place", _cell_of(F.col("embedding"), centres, everywhere))
    placed = materialise(placed, "corpus-cells").filter("place IS NOT NULL").select(
        "place.cell", "place.angle", F.col("embedding").alias("vector"), "label", "idx"
    )
    # A row per centre.
    spans = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle"), F.max("angle"))
    sizes, bounds = np.zeros(len(everywhere), np.int64), np.zeros((2, len(everywhere)))
    for cell, n, low, high in spans.collect():
        sizes[cell], bounds[:, cell] = n, (low, high)
    filled = sizes > 0
    # Small cells are searched together, so that a content is sent to all of them once.
    group_of = np.cumsum(sizes) // cell_rows
    groups = np.unique(group_of, return_inverse=True)[1]
    group_sizes = np.bincount(groups, sizes).astype(np.int64)
    group = F.get(F.array(*(F.lit(int(g)) for g in groups), F.lit(0)), F.col("cell"))
    placed = placed.withColumn("group", group)
    queries = materialise(contents.select(key, "vector"), "contents").filter("vector IS NOT NULL")
    queries = queries.withColumn("place", _cell_of(F.col("vector"), centres, filled))
    queries = materialise(queries, "content-cells").filter("place IS NOT NULL").select(
        key, "vector", "place.cell", F.array("place.cell").alias("cells"),
        F.array("place.angle").alias("angles"), F.lit(np.pi + 1).alias("reach"),
    )
    queries = queries.withColumn("group", group)
    home = queries.drop("cell")
    best = _best_of(_search(home, placed, group_sizes, key, cell_rows), key)
    best = materialise(best, "content-best")

    @F.arrow_udf("array<struct<group:int,reach:double,cells:array<int>,angles:array<double>>>")
    def others(vectors: pa.Array, sims: pa.Array, home: pa.Array) -> pa.Array:
        units = _units(_matrix(vectors))
        angles = np.arccos(np.clip(units @ centres.value.T, -1, 1))
        reach = np.arccos(np.clip(2 * sims.to_numpy() - 1, -1, 1)) + _SPARE
        apart = np.maximum(angles - bounds[1], bounds[0] - angles)
        near = (apart <= reach[:, None]) & filled
        near[np.arange(len(near)), home.to_numpy()] = False
        rows, cells = np.nonzero(near)
        # Cells are numbered group by group, so those of one content and group are neighbours.
        new = np.flatnonzero(np.diff(rows * len(groups) + groups[cells], prepend=-1))
        starts = pa.array(np.append(new, len(rows)).astype(np.int32))
        parts = [
            pa.array(groups[cells[new]].astype(np.int32)), pa.array(reach[rows[new]]),
            pa.ListArray.from_arrays(starts, pa.array(cells.astype(np.int32))),
            pa.ListArray.from_arrays(starts, pa.array(angles[rows, cells])),
        ]
        visits = pa.StructArray.from_arrays(parts, ["group", "reach", "cells", "angles"])
        ends = np.searchsorted(rows[new], np.arange(len(near) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), visits)

    visits = queries.join(best.select(key, "sim"), key).select(
        key, "vector", F.explode(others("vector", "sim", "cell")).alias("v")
    )
    visits = materialise(visits.select(key, "vector", "v.*"), "content-visits")
    return _best_of(best.union(_search(visits, placed, group_sizes, key, cell_rows)), key)


def _best_of(found: DataFrame, key: str) -> DataFrame:
    first = F.struct(F.col("sim"), -F.col("idx"))
    rows = found.groupBy(key).agg(
        F.max_by(F.struct("sim", "label", "idx"), first).alias("best"),
        F.sum("compared").alias("compared"),
    )
    return rows.select(key, "best.*", "compared")


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _centres(vectors: DataFrame, count: int, rounds: int = 6) -> np.ndarray:
    """Directions fitted on the corpus vectors whose ``idx`` hashes lowest; none of an empty one."""
    by_hash = vectors.orderBy(F.xxhash64("idx"), "idx").limit(_SAMPLE)
    units = _units(_matrix(_combined(by_hash.select("embedding").toArrow().column(0))))
    units = np.unique(units[(units != 0).any(axis=1)], axis=0)
    if not len(units):
        return np.zeros((0, 0))
    centres = units[np.linspace(0, len(units) - 1, min(count, len(units))).astype(int)]
    for _ in range(rounds):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        moved = _units(sums)
        centres = np.where((moved != 0).any(axis=1)[:, None], moved, centres)
    return centres


def _cell_of(vector: Column, centres, allowed: np.ndarray) -> Column:
    """Struct (cell, angle) of the nearest allowed centre; NULL for a vector without direction."""

    @F.arrow_udf("struct<cell:int,angle:double>")
    def place(batch: pa.Array) -> pa.Array:
        kind = pa.struct([("cell", pa.int32()), ("angle", pa.float64())])
        if not allowed.any() or not len(batch):
            return pa.nulls(len(batch), kind)
        units = _units(_matrix(batch))
        cosines = np.where(allowed, units @ centres.value.T, -np.inf)
        cells = cosines.argmax(axis=1)
        angles = np.arccos(np.clip(cosines[np.arange(len(cells)), cells], -1, 1))
        lost = pa.array(~(units != 0).any(axis=1))
        parts = [pa.array(cells.astype(np.int32)), pa.array(angles)]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=lost)

    return place(vector)


#: Visits that a task looks at together.
_VISITS_AT_ONCE = 1 << 19


def _slices(sizes: np.ndarray, most: int) -> list[slice]:
    """Neighbouring rows whose sizes add up to about ``most``."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    ends = [0, *edges.tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(ends, ends[1:]) if b > a]


def _search(
    visits: DataFrame, placed: DataFrame, sizes: np.ndarray, key: str, cell_rows: int
) -> DataFrame:
    """Best matches of visits (key, vector, group, reach, cells, angles) in those cells."""
    counts = np.zeros_like(sizes)
    for group, n in visits.groupBy("group").count().collect():
        counts[group] = n
    key_type = visits.schema[key].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.lexsort((right.column("angle").to_numpy(), right.column("cell").to_numpy()))
        right = right.take(pa.array(order))
        cells, angles = (right.column(n).to_numpy() for n in ("cell", "angle"))
        numbers = right.column("idx").to_numpy()
        vectors = _matrix(_combined(right.column("vector")))
        known = np.unique(cells)
        edges = np.append(np.searchsorted(cells, known), len(cells))
        blocks = {}
        sizes = pc.list_value_length(left.column("cells")).to_numpy()
        sims, best = np.full(len(left), np.nan), np.zeros(len(left), np.int64)
        compared = np.zeros(len(left), np.int64)
        for part in _slices(sizes, _VISITS_AT_ONCE):
            rows = left.slice(part.start, part.stop - part.start)
            wanted, reach = _matrix(_combined(rows.column("vector"))), rows.column("reach").to_numpy()
            own, angle = (_combined(rows.column(n)).flatten().to_numpy() for n in ("cells", "angles"))
            visitors = np.repeat(np.arange(len(rows)), sizes[part])
            # Visits of one cell together.
            order = np.argsort(own, kind="stable")
            found, starts = np.unique(own[order], return_index=True)
            for cell, some in zip(found.tolist(), np.split(order, starts[1:])):
                place = np.searchsorted(known, cell)
                if place == len(known) or known[place] != cell:
                    continue
                low, high = edges[place], edges[place + 1]
                # The rows of its cell that a content cannot rule out are neighbours.
                who = visitors[some]
                near = np.searchsorted(angles[low:high], angle[some] - reach[who], "left")
                far = np.searchsorted(angles[low:high], angle[some] + reach[who], "right")
                who = who[far > near]
                if not len(who):
                    continue
                if cell not in blocks:
                    blocks[cell] = _Nearest(vectors[low:high], numbers[low:high])
                block = blocks[cell]
                new, at = block.search(wanted[who])
                who, at = who + part.start, at + low
                compared[who] += high - low
                better = np.isnan(sims[who]) | (new > sims[who])
                better |= (new == sims[who]) & (numbers[at] < numbers[best[who]])
                better &= ~np.isnan(new)
                sims[who[better]], best[who[better]] = new[better], at[better]
        rows = np.flatnonzero(~np.isnan(sims))
        taken = pa.array(best[rows])
        return pa.table(
            [
                left.column(key).take(pa.array(rows)), pa.array(sims[rows]),
                right.column("label").take(taken), right.column("idx").take(taken),
                pa.array(compared[rows]),
            ],
            names=[key, "sim", "label", "idx", "compared"],
        )

    return compare_in_cells(
        visits, counts, placed, sizes, "group", compare,
        f"{key} {key_type}, sim double, label int, idx bigint, compared bigint", cell_rows,
    )


def page_vectors(
    content: Column,
    url_texts: Column,
    property_texts: Column,
    encoder: Encoder,
    corpus: HeadlineCorpus,
) -> Column:
    """Struct of the summed content vectors, the summed URL vectors and, for a broadcastable
    corpus, the nearest headline per property text.

    The three arrays mostly share their texts; every distinct text of an Arrow batch is
    encoded once for all of them.
    """
    shared = corpus.shared() if corpus.small else None
    vector = pa.list_(pa.float64())
    fields = "content:array<double>,url:array<double>"
    if shared:
        fields += f",nearest:array<{_NEAREST}>"

    @F.arrow_udf(f"struct<{fields}>")
    def score(*columns: pa.Array) -> pa.Array:
        lists = [[texts or [] for texts in column.to_pylist()] for column in columns]
        flat = [t or "" for column in lists for texts in column for t in texts]
        vectors, positions = encode_distinct(encoder, flat)
        ends = np.cumsum([0, *(len(texts) for column in lists for texts in column)])
        spans = [positions[a:b] for a, b in zip(ends, ends[1:])]
        n = len(lists[0])
        totals = [vectors[span].sum(axis=0) if len(span) else None for span in spans[: 2 * n]]
        parts = [pa.array(totals[:n], type=vector), pa.array(totals[n:], type=vector)]
        names = ["content", "url"]
        if shared:
            block, wanted = shared.value, positions[ends[2 * n] :]
            searched, which = np.unique(wanted, return_inverse=True)
            sims, rows = block.nearest(vectors[searched])
            starts = pa.array(ends[2 * n :] - ends[2 * n], type=pa.int32())
            found = block.as_structs(sims[which], rows[which])
            parts.append(pa.ListArray.from_arrays(starts, found))
            names.append("nearest")
        return pa.StructArray.from_arrays(parts, names=names)

    return score(content, url_texts, property_texts)


def is_property(sim: Column, label: Column, threshold) -> Column:
    """Whether a content string counts as clickbait at a similarity threshold."""
    return F.coalesce((sim >= threshold) & (label == 1), F.lit(False))


def property_share(nearest: Column, threshold) -> Column:
    """Share of clickbait strings in an array of nearest headlines, 0.0 for none."""
    hits = F.filter(nearest, lambda n: is_property(n["sim"], n["label"], threshold))
    return F.coalesce(F.try_divide(F.size(hits), F.size(nearest)), F.lit(0.0))


def clickbait_property_score(
    nearest: DataFrame, page: str, threshold: float = PROPERTY_THRESHOLD
) -> DataFrame:
    """Share of a page's content strings that are clickbait, from one row per string."""
    hit = is_property(F.col("sim"), F.col("label"), threshold)
    return nearest.groupBy(page).agg(F.avg(hit.cast("int")).alias("property_score"))
