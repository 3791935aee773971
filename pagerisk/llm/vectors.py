"""Near-duplicate vectors by product quantisation over coarse inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pagerisk.llm.components import connected_components
from pagerisk.session import materialise

#: Vectors that the lists and codebooks are fitted on, at most; all vectors are indexed.
SAMPLE = 8192
PARTS = 8
CODES = 256
#: Residents and visitors of a list that meet in one task.
_RESIDENTS = 4096
_VISITORS = 4096
_CHUNK = 256
#: Room for rounding in distances of unit vectors.
_SLACK = 1e-6


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest entry goes first, so nothing overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    out = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)
    return np.maximum(out, 0)


def k_means(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``count`` groups, started from rows spread over the sample."""
    count = min(count, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        nearest = distances(rows, centres).argmin(1)
        size = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        filled = size > 0
        centres[filled] = sums[filled] / size[filled, None]
    return centres


@dataclass
class Quantiser:
    """Coarse centres and one codebook of residuals per part of the space."""

    centres: np.ndarray
    codebooks: list[np.ndarray]
    splits: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        centres = k_means(sample, lists)
        residual = sample - centres[distances(sample, centres).argmin(1)]
        parts = min(PARTS, sample.shape[1])
        splits = np.linspace(0, sample.shape[1], parts + 1).astype(int)
        books = [
            k_means(residual[:, a:b], CODES) for a, b in zip(splits, splits[1:], strict=False)
        ]
        return cls(centres, books, splits)

    def parts(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, a:b] for a, b in zip(self.splits, self.splits[1:], strict=False)]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and distance to its own code of each row; distances to all lists."""
        far = distances(rows, self.centres)
        own = far.argmin(1)
        residual = rows - self.centres[own]
        codes, error = [], np.zeros(len(rows))
        for part, book in zip(self.parts(residual), self.codebooks, strict=True):
            apart = distances(part, book)
            code = apart.argmin(1)
            codes.append(code.astype(np.uint8))
            error += apart[np.arange(len(rows)), code]
        return own, np.stack(codes, 1), np.sqrt(error), far

    def probes(self, own: np.ndarray, far: np.ndarray, radius: float) -> np.ndarray:
        """Which lists may hold a vector within ``radius`` of each row.

        Such a vector lies on the other side of the plane between the two centres, or the
        row within ``radius`` of that plane. Nothing within the radius is ever missed.
        """
        gaps = np.sqrt(distances(self.centres, self.centres))[own]
        nearest = far[np.arange(len(own)), own][:, None]
        return far - nearest <= 2 * radius * gaps + _SLACK

    def tables(self, rows: np.ndarray, number: int) -> list[np.ndarray]:
        """Squared distance of each row's residual in a list to every code of each part."""
        residual = rows - self.centres[number]
        return [
            distances(part, book)
            for part, book in zip(self.parts(residual), self.codebooks, strict=True)
        ]


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.zeros((0, 0))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(np.float64)


_INDEX = "list int, codes binary, error double, probes array<int>"
_FOUND = "a struct<d:long,h:long>, b struct<d:long,h:long>, links long"


def _index(vectors: DataFrame, quantiser: Quantiser, radius: float) -> DataFrame:
    spark = vectors.sparkSession
    source = vectors.select("label", "d", "h", "copies", "embedding")
    schema = T.StructType(
        [*source.schema.fields, *spark.createDataFrame([], _INDEX).schema.fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                rows = unit_rows(_matrix(batch.column(4)))
                own, codes, error, far = quantiser.encode(rows)
                visits = quantiser.probes(own, far, radius)
                bounds = np.concatenate(([0], np.cumsum(visits.sum(1)))).astype(np.int32)
                lists = pa.array(np.nonzero(visits)[1].astype(np.int32))
                made = [
                    pa.array(own.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error),
                    pa.ListArray.from_arrays(pa.array(bounds), lists),
                ]
                kept = [batch.column(i) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema.names)

    return source.mapInArrow(run, schema)


def _chunks(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[low : low + _CHUNK] for low in range(0, len(rows), _CHUNK)]


def _compare(quantiser: Quantiser, threshold: float, radius: float):
    def run(group: pa.Table) -> pa.Table:
        visiting = group["visitor"].to_numpy()
        vectors = _matrix(group["embedding"])
        codes = group["codes"].to_pylist()
        d, h = group["d"].to_numpy(), group["h"].to_numpy()
        guests, hosts = np.flatnonzero(visiting), np.flatnonzero(~visiting)
        lists = group["list"].to_numpy()
        numbers, home = np.unique(lists[hosts], return_inverse=True)
        probes = group["probes"].to_pylist()
        copies = group["copies"].to_numpy()
        error = group["error"].to_numpy()
        code = np.zeros((len(group), len(quantiser.codebooks)), np.uint8)
        held = np.frombuffer(b"".join(codes[n] for n in hosts), np.uint8)
        code[hosts] = held.reshape(len(hosts), code.shape[1])
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        norm = np.sqrt((scaled**2).sum(1))
        units = scaled / norm[:, None]
        # A vector may be here as guest and as host.
        _, node = np.unique(np.stack((d, h), 1), axis=0, return_inverse=True)
        node = node.reshape(-1)
        label = np.arange(len(group))
        links = np.zeros(len(group), np.int64)
        visits = np.zeros((len(group), len(numbers)), bool)
        for guest in guests:
            visits[guest, np.flatnonzero(np.isin(numbers, probes[guest]))] = True
        calls = [
            (number, hosts[home == place], some)
            for place, number in enumerate(numbers.tolist())
            for some in _chunks(np.flatnonzero(visits[:, place]))
        ]
        for number, here, some in calls:
            tables = quantiser.tables(units[some], number)
            apart = np.zeros((len(some), len(here)))
            for part, table in enumerate(tables):
                apart += table[:, code[here, part]]
            # A host is at most its code's error nearer than its code.
            left, right = np.nonzero(np.sqrt(apart) - error[here] <= radius + _SLACK)
            one, other = some[left], here[right]
            cosine = np.einsum("ij,ij->i", scaled[one], scaled[other]) / (norm[one] * norm[other])
            linked = (cosine >= threshold) & (node[one] != node[other])
            one, other = one[linked], other[linked]
            np.add.at(links, one, copies[other])
            one, other = node[one], node[other]
            while True:
                least = np.minimum(label[one], label[other])
                if (label[one] == least).all() and (label[other] == least).all():
                    break
                np.minimum.at(label, label[one], least)
                np.minimum.at(label, label[other], least)
                np.minimum.at(label, one, least)
                np.minimum.at(label, other, least)
                label = label[label]
        while (label[label] != label).any():
            label = label[label]
        first = np.zeros(len(group), np.int64)
        first[node[::-1]] = np.arange(len(group))[::-1]
        told = np.flatnonzero((links > 0) | (label[node] != node))
        head = first[label[node[told]]]
        kind = pa.struct([("d", pa.int64()), ("h", pa.int64())])

        def nodes(at):
            return pa.StructArray.from_arrays([pa.array(d[at]), pa.array(h[at])], fields=list(kind))

        return pa.table({"a": nodes(told), "b": nodes(head), "links": pa.array(links[told])})

    return run


def _deal(index: DataFrame) -> DataFrame:
    """Residents and visitors of the lists, dealt to tasks of bounded size.

    Neighbouring lists of a label share a shelf until it holds _RESIDENTS, so that a visitor
    is sent once to a shelf and not once to each list. A shelf that still holds more, or gets
    more than _VISITORS, is cut into blocks by hash, and every two blocks meet.
    """
    before = Window.partitionBy("label").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    shelves = (
        index.groupBy("label", "list")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("shelf", F.floor(F.col("before") / _RESIDENTS).cast("int"))
    )
    shelves = materialise(shelves.select("label", "list", "shelf", "n"), "vectors-shelves")
    place = F.map_from_entries(F.collect_list(F.struct("list", "shelf"))).alias("place")
    places = shelves.groupBy("label").agg(place)

    def visited(rows):
        found = F.filter(F.transform("probes", lambda x: F.col("place")[x]), F.isnotnull)
        return rows.join(places, "label").withColumn("visits", F.array_distinct(found))

    guests = visited(index.select("label", "probes")).select("label", F.explode("visits").alias("shelf"))
    guests = guests.groupBy("label", "shelf").agg(
        F.ceil(F.count("*") / _VISITORS).cast("int").alias("guests")
    )
    hosts = shelves.groupBy("label", "shelf").agg(
        F.ceil(F.sum("n") / _RESIDENTS).cast("int").alias("hosts")
    )
    entry = F.struct("shelf", F.struct("hosts", "guests"))
    blocks = (
        hosts.join(guests, ["label", "shelf"])
        .groupBy("label")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("blocks"))
    )
    rows = visited(index).join(blocks, "label")
    own = F.xxhash64("d", "h")
    at = F.col("blocks")[F.col("shelf")]
    every = lambda n: F.sequence(F.lit(0), at[n] - 1)
    mine = lambda n: F.array(F.pmod(own, at[n]).cast("int"))
    home = F.struct(F.col("place")[F.col("list")].alias("shelf"), F.lit(False).alias("visitor"))
    away = F.transform("visits", lambda x: F.struct(x.alias("shelf"), F.lit(True).alias("visitor")))
    rows = rows.withColumn("role", F.explode(F.concat(F.array(home), away)))
    rows = rows.select("*", "role.shelf", "role.visitor")
    rows = rows.withColumn(
        "host_block", F.explode(F.when(F.col("visitor"), every("hosts")).otherwise(mine("hosts")))
    ).withColumn(
        "guest_block",
        F.explode(F.when(F.col("visitor"), mine("guests")).otherwise(every("guests"))),
    )
    only = lambda name, role: F.when(role, F.col(name)).alias(name)
    return rows.select(
        "label", "shelf", "host_block", "guest_block", "visitor", "d", "h", "copies", "embedding",
        "list", "error", only("codes", ~F.col("visitor")), only("probes", F.col("visitor")),
    )


def near_vectors(
    rows: DataFrame,
    *,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    n_lists: int | None = None,
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept.

    Vectors of equal label link where their cosine reaches ``threshold``. Equal vectors of a
    label are folded into one first. A sample of at most SAMPLE vectors, taken by hash,
    fits the centres (``n_lists``, or the root of the vectors per label, an eighth of the
    sample at most) and the codebooks. Every vector is put into the list of its nearest
    centre with the codes of its residual, and visits every list that can hold a partner.
    There the distances to all residents are read from tables; a resident is passed over
    only if the distance to its code, less that code's own error, rules a link out. The rest
    are compared exactly, so no link is missed. A task returns, per vector, the number of its
    links and one vector that it is joined to, never the pairs.

    n_links counts other vectors, repeated rows included; component_id is the smallest id
    reachable; kept tells whether it is the vector's own. NULL, empty and zero vectors,
    those with NULL or non-finite entries, and those with a NULL label or id link with
    nothing; a NULL id has a NULL component and is kept. Vectors of different lengths do
    not link. Other columns are ignored; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    vector = F.col("embedding")
    good = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    given = rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).alias("embedding"),
    )
    given = given.withColumn("good", F.coalesce(good, F.lit(False)))
    mark = F.struct(F.xxhash64("label", vector).alias("x"), F.hash(vector).alias("y"))
    given = materialise(given.withColumn("mark", mark), "vectors")
    unlike = F.struct("label", F.size(vector).alias("dim"))
    distinct = (
        given.filter("good")
        .groupBy("label", "mark")
        .agg(
            F.min("vec_id").alias("d"),
            F.count("*").alias("copies"),
            F.min_by("embedding", "vec_id").alias("embedding"),
        )
        .withColumn("h", F.col("mark.x"))
        .withColumn("label", unlike)
    )
    distinct = materialise(distinct, "vectors-distinct")
    heads, links = _links(distinct, threshold, n_lists)
    named = distinct.select(
        F.col("label.label").alias("label"), "mark", "copies", F.struct("d", "h").alias("node")
    )
    named = named.join(heads, "node", "left").join(links, "node", "left")
    named = named.select(
        "label", "mark",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component.d", "node.d").alias("component_id"),
        F.lit(True).alias("good"),
    )
    out = given.select("vec_id", "label", "mark", "good").join(
        named, ["label", "mark", "good"], "left"
    )
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _links(distinct: DataFrame, threshold: float, n_lists: int | None):
    """(node, component) and (node, links) of the distinct vectors, each length by itself."""
    spark = distinct.sparkSession
    sizes = distinct.groupBy("label.dim").agg(
        F.count("*").alias("count"), F.countDistinct("label").alias("labels")
    )
    found = None
    for row in sizes.collect():
        vectors = distinct.filter(F.col("label.dim") == row["dim"])
        sample = vectors.orderBy("h", "d").limit(SAMPLE).select("embedding").toArrow()
        usual = int((row["count"] / row["labels"]) ** 0.5)
        lists = n_lists or max(1, min(usual, sample.num_rows // 8))
        quantiser = Quantiser.fit(unit_rows(_matrix(sample["embedding"])), lists)
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        index = materialise(_index(vectors, quantiser, radius), "vectors-index")
        compared = (
            _deal(index)
            .groupBy("label", "shelf", "host_block", "guest_block")
            .applyInArrow(_compare(quantiser, threshold, radius), _FOUND)
        )
        found = compared if found is None else found.union(compared)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    found = materialise(found, "vectors-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return connected_components(found.select("a", "b")), links
