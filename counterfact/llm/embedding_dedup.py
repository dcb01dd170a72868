"""Near duplicates of embeddings by product quantisation over inverted lists.

**Index.** Coarse centroids cut the vectors of a label into lists, and the rest of a vector (vector less
centroid) is coded by the nearest codeword in each of eight subspaces. Centroids and codewords are fitted on a
bounded sample; every vector is indexed. A vector asks its own list, and every list of a higher number whose
border is so near that a link may reach over it: at most ``REACH`` standard deviations of the step that a link
takes towards the border. In a list the distances come from lookup tables of the asker against the codes. The
stored error of a code bounds what the table may be wrong by, so no link inside a list is lost, and what
remains is compared exactly.

**Dense groups.** Where the sample shows many vectors within half the angle of a link around one point, a ball
is made of them. All vectors in a ball are linked with each other, however many there are, and are counted, not
compared. A vector outside whose angle to the centre leaves no doubt is counted likewise; only those in doubt
are compared with the members.

A list or ball of more than ``PIECE`` members is cut into pieces, and pairs of pieces are tasks of their own.
Nothing is dropped: no list, ball, or number of partners has a cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from counterfact.llm.batches import quoted
from counterfact.llm.components import components
from counterfact.llm.shipping import ship
from counterfact.llm.staging import partitions_for, stage
from counterfact.llm.vectors import bytes_column, finite_rows, matrix_of, same_length, units, vector_column

#: Vectors that the index is fitted on, at most, and those of one label that balls are looked for among.
SAMPLE, BALL_SAMPLE = 16_384, 4_096
#: Sampled vectors that a ball needs; so there are SAMPLE / BALL_LEAST balls at most.
BALL_LEAST = 8
#: Vectors of a list that are aimed at for the largest label, and the most centroids.
LIST_ROWS, MOST_LISTS = 512, 1_024
#: Subspaces, codewords of each.
SUBSPACES, CODEWORDS = 8, 256
#: Standard deviations by which a link may cross the border of a list.
REACH = 3.0
#: Members of a list or ball that a task holds; lists that are cut are those above it and above 1 in HEAVY rows.
PIECE, HEAVY = 4_096, 1 << 16
#: Vectors that ask at a time.
STRIPE = 256
#: Doubt of an angle, in radians, and of a looked-up cosine.
ANGLE_DOUBT, LOOKUP_DOUBT = 1e-6, 1e-5

PLACED = (
    "row bigint, id bigint, label string, dim int, raw binary, ball int, angle double, home int, lists array<int>, "
    "balls array<struct<ball:int,angle:double>>, codes binary, error double"
)
BLOCK = (
    "kind tinyint, label string, target int, i int, j int, piece int, visitor boolean, row bigint, node bigint, "
    "dim int, raw binary, home int, codes binary, error double"
)
FOUND = "row bigint, n bigint, node bigint, root bigint"
LIST, BALL, OTHER = 0, 1, -1


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centroids of the rows of ``x``; at most ``k``, fewer if there are fewer rows."""
    rng = np.random.default_rng(seed)
    centers = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        at = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest center of every row."""
    half = 0.5 * np.einsum("ij,ij->i", centers, centers)
    return np.concatenate(
        [np.argmax(x[at : at + 8192] @ centers.T - half, axis=1) for at in range(0, len(x), 8192)] or [np.zeros(0, int)]
    )


class Index:
    """Centroids, codewords and balls, fitted on a sample of unit vectors and their labels."""

    def __init__(self, sample: np.ndarray, labels: list[str], threshold: float, n_lists: int):
        self.threshold, self.angle = threshold, math.acos(threshold)
        self.dim = sample.shape[1]
        self.centers = kmeans(sample, max(1, min(n_lists, MOST_LISTS, len(sample) // 8)))
        rest = sample - self.centers[nearest(sample, self.centers)]
        parts = np.array_split(np.arange(self.dim), min(SUBSPACES, max(1, self.dim)))
        self.parts = [(int(p[0]), int(p[-1]) + 1) for p in parts if len(p)]
        self.words = [kmeans(rest[:, a:b], CODEWORDS, seed=1) for a, b in self.parts]
        self._borders(rest)
        self._balls(sample, labels)

    def _borders(self, rest: np.ndarray) -> None:
        """How far from a border a vector is that no link is expected to reach over."""
        spread = np.linalg.eigvalsh(np.atleast_2d(np.cov(rest, rowvar=False))) if len(rest) > 1 else np.ones(1)
        directions = max(1.0, float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)))
        longest = math.sqrt(2 - 2 * self.threshold)
        self.reach = min(longest, REACH * longest / math.sqrt(directions))
        between = self.centers[:, None, :] - self.centers[None, :, :]
        self.gaps = np.maximum(np.sqrt((between**2).sum(axis=2)), 1e-12)

    def _balls(self, sample: np.ndarray, labels: list[str]) -> None:
        by: dict[str, list[int]] = {}
        for i, label in enumerate(labels):
            by.setdefault(label, []).append(i)
        self.radius = self.angle / 2 - ANGLE_DOUBT
        points, self.of_label = [], {}
        for label in sorted(by):
            x = sample[by[label][:BALL_SAMPLE]]
            near = (x @ x.T >= math.cos(max(self.radius, 0.0))).astype(np.float32)
            free = np.ones(len(x), np.float32)
            while len(x) >= BALL_LEAST and self.radius > 0:
                counts = (near @ free) * free
                at = int(np.argmax(counts))
                if counts[at] < BALL_LEAST:
                    break
                point = units(x[(near[at] > 0) & (free > 0)].mean(axis=0, keepdims=True))[0]
                self.of_label.setdefault(label, []).append(len(points))
                points.append(point)
                free[at] = 0
                free[x @ point >= math.cos(self.radius)] = 0
        self.points = np.array(points).reshape(len(points), self.dim)

    def place(self, x: np.ndarray, labels: list[str]) -> dict[str, list]:
        """Where unit vectors belong, and what they ask."""
        n = len(x)
        dots = x @ self.centers.T
        distance = 0.5 * np.einsum("ij,ij->i", self.centers, self.centers) - dots
        home = np.argmin(distance, axis=1)
        margin = (distance - distance[np.arange(n), home][:, None]) / self.gaps[home]
        asks = (margin <= self.reach) & (np.arange(len(self.centers)) > home[:, None])
        codes, error = self.encode(x, home)

        ball, angle = np.full(n, -1), np.zeros(n)
        near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.points):
            of = np.array([label if label in self.of_label else "" for label in labels], object)
            for label, numbers in self.of_label.items():
                rows = np.flatnonzero(of == label)
                if not len(rows):
                    continue
                angles = np.arccos(np.clip(x[rows] @ self.points[numbers].T, -1, 1))
                best = np.argmin(angles, axis=1)
                least = angles[np.arange(len(rows)), best]
                inside = least <= self.radius
                ball[rows[inside]] = np.array(numbers)[best[inside]]
                angle[rows] = least
                # A vector of a ball asks only balls of a lower number, so that a pair meets once.
                below = np.where(inside, np.array(numbers)[best], len(self.points))
                asked = (angles <= 1.5 * self.angle + ANGLE_DOUBT) & (np.array(numbers) < below[:, None])
                for r, c in zip(*np.nonzero(asked), strict=True):
                    near[rows[r]].append((numbers[c], float(angles[r, c])))
        asks &= (ball < 0)[:, None]
        lists = [np.flatnonzero(a).tolist() for a in asks]
        return {"ball": ball, "angle": angle, "home": home, "lists": lists, "balls": near, "codes": codes, "error": error}

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the rest of each vector, and the length of what the codes leave out."""
        rest = x - self.centers[home]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        for s, (a, b) in enumerate(self.parts):
            codes[:, s] = nearest(rest[:, a:b], self.words[s])
            rest[:, a:b] -= self.words[s][codes[:, s]]
        return codes, np.sqrt(np.einsum("ij,ij->i", rest, rest))

    def lookup(self, asking: np.ndarray, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Cosines of whole vectors (rows) with coded ones (columns), by tables."""
        out = (asking @ self.centers.T).astype(np.float32)[:, home]
        for s, (a, b) in enumerate(self.parts):
            table = (asking[:, a:b] @ self.words[s].T).astype(np.float32)
            out += table[:, codes[:, s]]
        return out


class Links:
    """Links that were found among the vectors of a task: how many each has, and which hang together."""

    def __init__(self, n: int):
        self.count, self.group = np.zeros(n, np.int64), np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        np.add.at(self.count, a, 1)
        np.add.at(self.count, b, 1)
        while True:
            x, y = self.group[a], self.group[b]
            least = np.minimum(x, y)
            if (x == y).all():
                break
            np.minimum.at(self.group, x, least)
            np.minimum.at(self.group, y, least)
            while (self.group[self.group] != self.group).any():
                self.group = self.group[self.group]


def compare(index: Index, block: dict[str, np.ndarray], asking: np.ndarray, asked: np.ndarray, once: bool, links: Links):
    """Links between two sets of places in a block; ``once``: the sets are one, and a pair counts once."""
    x, coded = block["x"], block["home"][asked] >= 0
    exact_only = not (len(asked) and coded.all())
    for at in range(0, len(asking), STRIPE):
        own = asking[at : at + STRIPE]
        if exact_only:
            maybe = np.ones((len(own), len(asked)), bool)
        else:
            near = index.lookup(x[own], block["home"][asked], block["codes"][asked])
            maybe = near >= index.threshold - block["error"][asked] - LOOKUP_DOUBT
        if once:
            maybe &= asked > own[:, None]
        a, b = np.nonzero(maybe)
        if len(a) > 0.1 * maybe.size:
            sure = maybe & (x[own] @ x[asked].T >= index.threshold)
            a, b = np.nonzero(sure)
        else:
            sure = np.einsum("ij,ij->i", x[own[a]], x[asked[b]]) >= index.threshold
            a, b = a[sure], b[sure]
        links.add(own[a], asked[b])


def near_copies(
    df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for every row of ``df``.

    Vectors are linked if their labels are equal and their cosine is ``threshold`` or more; ``component_id`` is
    the smallest id that links reach, and the vector of that id is kept. A vector that is null, empty, zero, or
    has null or non-finite components links with nothing, nor does one without label or id; vectors link with
    those of their own length only. Rows of one id are vectors of their own that share a component, and
    repeated rows are links of each other. Other columns are ignored. An empty table gives an empty one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark = df.sparkSession
    ship(spark)
    vector, kind = vector_column(df, vector_col)
    rows = df.select(
        F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(label_col)).cast("string").alias("label"), vector.alias("v")
    )
    index = spark.sparkContext.broadcast(_fit(rows, threshold))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v")
    placed = stage(numbered.mapInArrow(_placing(index, kind), PLACED), "placed_vectors")

    balls = _ball_table(placed, index.value.angle)
    with_node = placed.join(F.broadcast(balls.select("ball", "rep")), "ball", "left")
    with_node = with_node.withColumn("node", F.coalesce("rep", "id"))
    visits = _ball_visits(with_node, balls, index.value.angle)
    blocks = _blocks(with_node, visits, placed, balls)
    keys = ["kind", "label", "target", "i", "j"]
    n_blocks = partitions_for(placed, placed.count(), 50_000)
    dealt = blocks.repartition(n_blocks, *keys).sortWithinPartitions(*keys, "row")
    found = stage(dealt.mapInArrow(_comparing(index, kind), FOUND), "vector_links")

    sure = visits.where("sure")
    links = found.select("row", "n").unionByName(sure.select("row", F.col("members").alias("n")))
    links = links.groupBy("row").agg(F.sum("n").alias("n"))
    edges = found.where("node <> root").select("node", "root")
    edges = edges.union(sure.where("node <> rep").select("node", "rep")).distinct()
    reached = components(edges, "node", "root", "vector-links")

    of_ball = balls.join(reached, F.col("rep") == F.col("node"), "left").select(
        "ball", (F.col("members") - 1 + F.col("sure_in")).alias("within"), F.coalesce("component", "rep").alias("component_id")
    )
    counted = placed.select("row", "id", "ball").join(links, "row", "left")
    in_ball = counted.where("ball IS NOT NULL").join(F.broadcast(of_ball), "ball")
    in_ball = in_ball.select("id", (F.coalesce("n", F.lit(0)) + F.col("within")).alias("n_links"), "component_id")
    alone = counted.where("ball IS NULL").join(reached, F.col("id") == F.col("node"), "left")
    alone = alone.select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    both = in_ball.unionByName(alone)
    return both.select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("bigint").alias("n_links"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _fit(rows: DataFrame, threshold: float) -> Index:
    """The index of a sample of SAMPLE vectors at most, taken by the hash of the id."""
    usable = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    per_label = usable.groupBy("label").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    n, most = per_label["n"] or 0, per_label["most"] or 0
    place = F.xxhash64("id", F.lit("sample"))
    slots = 1 << 40
    share = int(min(1.0, 1.5 * SAMPLE / max(n, 1)) * slots)
    picked = usable.where(F.pmod(place, F.lit(slots)) < share).orderBy(place, "id").limit(SAMPLE).select("label", "v").toArrow()
    labels = picked["label"].to_pylist()
    values, bounds, whole = finite_rows(picked["v"].combine_chunks())
    groups = same_length(values, bounds, np.flatnonzero(whole))
    groups = [(own, x) for own, x in ((own, units(x)) for own, x in groups) if x.shape[1]]
    if not groups:
        return Index(np.zeros((1, 1)), [""], threshold, 1)
    own, x = max(groups, key=lambda g: len(g[0]))
    return Index(x, [labels[i] for i in own.tolist()], threshold, 1 << max(0, math.ceil(math.log2(max(1, most / LIST_ROWS)))))


def _placing(index, kind: type):
    """Rows of PLACED from rows (row, id, label, v). A vector that links with nothing has no label."""
    schema = to_arrow_schema(_parse_datatype_string(PLACED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ident, label, vectors = batch.columns
            values, bounds, whole = finite_rows(vectors)
            whole &= ident.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False)
            groups = same_length(values, bounds, np.flatnonzero(whole))
            rest = ~whole
            for own, matrix in groups:
                zero = ~np.abs(matrix).any(axis=1) if matrix.shape[1] else np.ones(len(own), bool)
                rest[own[zero]] = True
                own, matrix = own[~zero], matrix[~zero]
                if len(own):
                    yield part(row.take(pa.array(own)), ident.take(pa.array(own)), label.take(pa.array(own)), matrix)
            others = pa.array(np.flatnonzero(rest))
            if len(others):
                none = [pa.nulls(len(others), f.type) for f in schema][2:]
                yield pa.RecordBatch.from_arrays([row.take(others), ident.take(others), *none], schema=schema)

    def part(row, ident, label, matrix: np.ndarray) -> pa.RecordBatch:
        n, dim = matrix.shape
        dims, raw = pa.array(np.full(n, dim), pa.int32()), bytes_column(matrix.astype(kind))
        if dim == index.value.dim:
            p = index.value.place(units(matrix), label.to_pylist())
            made = [
                pa.array(p["ball"], pa.int32(), mask=p["ball"] < 0),
                pa.array(p["angle"], pa.float64()),
                pa.array(p["home"], pa.int32()),
                pa.array(p["lists"], schema.field("lists").type),
                pa.array([[{"ball": b, "angle": a} for b, a in v] for v in p["balls"]], schema.field("balls").type),
                bytes_column(p["codes"]),
                pa.array(p["error"], pa.float64()),
            ]
        else:  # vectors of another length: one list of their own for each label and length, without codes
            made = [pa.nulls(n, f.type) for f in schema][5:]
            made[2] = pa.array(np.full(n, OTHER - dim), pa.int32())
        return pa.RecordBatch.from_arrays([row, ident, label, dims, raw, *made], schema=schema)

    return run


def _ball_table(placed: DataFrame, angle: float) -> DataFrame:
    """Balls (SAMPLE / BALL_LEAST at most) with members, reach and least id, and who asks them."""
    inside = placed.where("ball IS NOT NULL").groupBy("ball")
    inside = inside.agg(F.count("*").alias("members"), F.max("angle").alias("reach"), F.min("id").alias("rep"))
    table = _local(inside, "ball int, members bigint, reach double, rep bigint")
    asked = _ball_visits(placed.withColumn("node", F.col("id")), table, angle).groupBy("ball")
    asked = asked.agg(F.sum(F.col("sure").cast("bigint")).alias("sure_in"), F.sum((~F.col("sure")).cast("bigint")).alias("asking"))
    whole = table.join(asked, "ball", "left").na.fill(0, ["sure_in", "asking"])
    return _local(whole, "ball int, members bigint, reach double, rep bigint, sure_in bigint, asking bigint")


def _local(df: DataFrame, ddl: str) -> DataFrame:
    """A table of bounded size, held by the driver."""
    return df.sparkSession.createDataFrame([tuple(r) for r in df.select(*_parse_datatype_string(ddl).names).collect()], ddl)


def _ball_visits(placed: DataFrame, balls: DataFrame, angle: float) -> DataFrame:
    """Vectors that ask a ball: linked with all its members (``sure``), or with some perhaps."""
    asked = placed.select("row", "node", "dim", "raw", "home", F.explode("balls").alias("asked")).select(
        "row", "node", "dim", "raw", "home", F.col("asked.ball").alias("ball"), F.col("asked.angle").alias("away")
    )
    table = F.broadcast(balls.select("ball", "members", "reach", F.col("rep")))
    known = asked.join(table, "ball").where(F.col("away") - F.col("reach") <= angle + ANGLE_DOUBT)
    return known.withColumn("sure", F.col("away") + F.col("reach") <= angle - ANGLE_DOUBT)


def _blocks(with_node: DataFrame, visits: DataFrame, placed: DataFrame, balls: DataFrame) -> DataFrame:
    """Rows of BLOCK: every vector in each block that compares it.

    Members of a list or ball come in ``s`` pieces and those that ask in ``t``. Block (i, j), j < s, compares the
    pieces i and j of a list; block (i, s + v) compares piece i with piece v of those that ask, unless these
    are one piece, which then is a part of the blocks (i, i).
    """
    homes = placed.where("home IS NOT NULL AND ball IS NULL").groupBy("label", F.col("home").alias("target"))
    homes = homes.agg(F.count("*").alias("s"), F.lit(0).cast("bigint").alias("t"))
    asks = placed.select("label", F.explode("lists").alias("target")).groupBy("label", "target")
    asks = asks.agg(F.lit(0).cast("bigint").alias("s"), F.count("*").alias("t"))
    sizes = homes.unionByName(asks).groupBy("label", "target").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    least = max(PIECE, placed.count() // HEAVY)
    heavy = sizes.where((F.col("s") > least) | (F.col("t") > least)).withColumn("kind", F.lit(LIST).cast("tinyint"))
    of_balls = balls.where("asking > 0").select(
        F.lit(None).cast("string").alias("label"),
        F.col("ball").alias("target"),
        F.col("members").alias("s"),
        F.col("asking").alias("t"),
        F.lit(BALL).cast("tinyint").alias("kind"),
    )
    pieces = heavy.unionByName(of_balls.where((F.col("s") > least) | (F.col("t") > least)))
    pieces = _local(pieces, "label string, target int, s bigint, t bigint, kind tinyint")
    cut = F.broadcast(
        pieces.select(F.coalesce("label", F.lit("")).alias("_label"), F.col("target").alias("_target"), F.col("kind").alias("_kind"), "s", "t")
    )

    def role(df: DataFrame, kind: int, target: str, visitor: bool) -> DataFrame:
        return df.select(
            F.lit(kind).cast("tinyint").alias("kind"),
            (F.col("label") if kind == LIST else F.lit("")).alias("label"),
            F.col(target).alias("target"),
            F.lit(visitor).alias("visitor"),
            *["row", "node", "dim", "raw", "home"],
            *[(F.lit(None).cast(t) if visitor else F.col(c)).alias(c) for c, t in (("codes", "binary"), ("error", "double"))],
        )

    asked_balls = F.broadcast(balls.where("asking > 0").select("ball"))
    parts = [
        role(with_node.where("home IS NOT NULL AND ball IS NULL"), LIST, "home", False),
        role(with_node.withColumn("list", F.explode("lists")), LIST, "list", True),
        role(with_node.join(asked_balls, "ball", "left_semi"), BALL, "ball", False),
        role(visits.where("NOT sure"), BALL, "ball", True),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    on = (F.col("kind") == F.col("_kind")) & (F.col("label") == F.col("_label")) & (F.col("target") == F.col("_target"))
    rows = rows.join(cut, on, "left")
    count = lambda c: F.greatest(F.ceil(F.coalesce(c, F.lit(1)) / PIECE), F.lit(1)).cast("int")
    rows = rows.withColumns({"s": count("s"), "t": count("t")})
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("row"), F.when(F.col("visitor"), F.col("t")).otherwise(F.col("s"))).cast("int"))
    return rows.withColumn("cell", F.explode(_cells())).select(
        "kind", "label", "target", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "piece", "visitor",
        "row", "node", "dim", "raw", "home", "codes", "error",
    )


def _cells() -> Column:
    """Blocks that a row is a part of."""
    piece, s, t = F.col("piece"), F.col("s"), F.col("t")
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = F.transform(F.sequence(F.lit(0), s - 1), lambda k: cell(F.least(piece, k), F.greatest(piece, k)))
    apart = F.transform(F.sequence(F.lit(0), t - 1), lambda v: cell(piece, s + v))
    alone = F.array(cell(piece, piece))
    member = F.when((F.col("kind") == BALL) & (t > 1), apart).when(F.col("kind") == BALL, alone)
    member = member.when(t > 1, F.concat(own, apart)).otherwise(own)
    visitor = F.transform(F.sequence(F.lit(0), s - 1), lambda i: cell(i, F.when(t > 1, s + piece).otherwise(i)))
    return F.when(F.col("visitor"), visitor).otherwise(member)


def _comparing(index, kind: type):
    """Rows of FOUND from the blocks of a partition, which comes sorted by block."""
    schema = to_arrow_schema(_parse_datatype_string(FOUND))

    def result(rows: pa.Table) -> pa.RecordBatch | None:
        get = lambda c: rows[c].combine_chunks()
        visitor, piece = get("visitor").to_numpy(zero_copy_only=False), get("piece").to_numpy()
        if visitor.all() or len(visitor) < 2:
            return None
        home = get("home").to_numpy()
        coded = home >= 0
        block = {"x": units(matrix_of(get("raw"), kind)), "home": home}
        places = np.arange(len(home))
        members = places[~visitor]
        if coded.all():
            parts = len(index.value.parts)
            block["codes"], block["error"] = np.zeros((len(home), parts), np.uint8), np.zeros(len(home))
            block["codes"][members] = matrix_of(get("codes").filter(pa.array(~visitor)), np.uint8)
            block["error"][members] = get("error").to_numpy(zero_copy_only=False)[members]
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        links = Links(len(home))
        if visitor.any():
            compare(index.value, block, places[visitor], members, False, links)
        if i == j and rows["kind"][0].as_py() == LIST:
            compare(index.value, block, members, members, True, links)
        elif not visitor.any():
            compare(index.value, block, members[piece[members] == i], members[piece[members] == j], False, links)
        linked = np.flatnonzero(links.count)
        if not len(linked):
            return None
        node = get("node").to_numpy()
        least = np.full(len(home), np.iinfo(np.int64).max)
        np.minimum.at(least, links.group, node)
        arrays = [get("row").to_numpy()[linked], links.count[linked], node[linked], least[links.group[linked]]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "label", "target", "i", "j")]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(k[a] for k in keys)
                if last is not None and key != last:
                    if (out := result(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held and (out := result(pa.Table.from_batches(held))) is not None:
            yield out

    return run
