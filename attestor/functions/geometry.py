"""Half-open integer boxes [x1, y1, x2, y2]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.numeric import col
from attestor.functions.vectors import bound


def area(box) -> Column:
    b = col(box)
    return (b[2] - b[0]) * (b[3] - b[1])


def total_area(boxes) -> Column:
    return F.aggregate(col(boxes), F.lit(0).cast("long"), lambda a, b: a + area(b))


def valid(box, width, height) -> Column:
    b = col(box)
    ok = (F.size(b) == 4) & (F.get(b, F.lit(0)) >= 0) & (F.get(b, F.lit(0)) < F.get(b, F.lit(2))) & (F.get(b, F.lit(2)) <= col(width))
    ok = ok & (F.get(b, F.lit(1)) >= 0) & (F.get(b, F.lit(1)) < F.get(b, F.lit(3))) & (F.get(b, F.lit(3)) <= col(height))
    return F.coalesce(ok, F.lit(False))


def intersection(a, b) -> Column:
    a, b = col(a), col(b)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    return w * h


def overlaps(a, b) -> Column:
    return intersection(a, b) > 0


def iou(a, b) -> Column:
    i = intersection(a, b)
    return F.try_divide(i.cast("double"), (area(a) + area(b) - i).cast("double"))


def union(a, b) -> Column:
    a, b = col(a), col(b)
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def padded(box, width, height, share: float = 0.15) -> Column:
    """Grow by a share of each side, outwards to whole pixels, within the image."""
    b = col(box)
    dx, dy = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    return F.array(
        F.greatest(F.floor(b[0] - dx), F.lit(0)).cast("int"),
        F.greatest(F.floor(b[1] - dy), F.lit(0)).cast("int"),
        F.least(F.ceil(b[2] + dx), col(width)).cast("int"),
        F.least(F.ceil(b[3] + dy), col(height)).cast("int"),
    )


def center_distance(a, b, width, height) -> Column:
    """Distance of the centres, in shares of the image's sides."""
    a, b = col(a), col(b)
    dx = ((a[0] + a[2]) - (b[0] + b[2])) / 2.0 / col(width)
    dy = ((a[1] + a[3]) - (b[1] + b[3])) / 2.0 / col(height)
    return F.hypot(dx, dy)


def center_score(boxes, width, height) -> Column:
    """Minus the smallest squared distance of a box's centre from the image's; -inf without a box."""
    def one(b):
        return -(F.pow((b[0] + b[2]) * 0.5 - col(width) / 2.0, 2) + F.pow((b[1] + b[3]) * 0.5 - col(height) / 2.0, 2))

    return F.coalesce(F.array_max(F.transform(col(boxes), one)), F.lit(float("-inf")))


#: Rows and columns of the proposal grids.
GRIDS = ((3, 3), (1, 2), (2, 1))


def grid(width, height) -> Column:
    """Boxes of the fixed grids, then the whole image, rounded half to even."""
    def edge(k, n, size):
        return F.bround(F.lit(k) * col(size).cast("double") / n).cast("int")

    boxes = [F.array(edge(c, cs, width), edge(r, rs, height), edge(c + 1, cs, width), edge(r + 1, rs, height)) for rs, cs in GRIDS for r in range(rs) for c in range(cs)]
    return F.array(*boxes, F.array(F.lit(0), F.lit(0), col(width).cast("int"), col(height).cast("int")))


def from_one_based(xmin, ymin, xmax, ymax, width, height) -> Column:
    """1-based inclusive corners to a half-open box within the image."""
    zero = F.lit(0)
    return F.array(F.greatest(zero, col(xmin) - 1), F.greatest(zero, col(ymin) - 1), F.least(col(width), col(xmax)), F.least(col(height), col(ymax)))


def center_crop(box, width, height, crop: int = 224) -> Column:
    """A box after the short side is scaled to ``crop`` and the middle square is cut out: box (not cut) and the share of it that is visible."""
    b = col(box)
    s = F.lit(float(crop)) / F.least(col(width), col(height))
    ox, oy = (col(width) * s - crop) / 2.0, (col(height) * s - crop) / 2.0
    x1, y1, x2, y2 = b[0] * s - ox, b[1] * s - oy, b[2] * s - ox, b[3] * s - oy
    zero, side = F.lit(0.0), F.lit(float(crop))
    seen = F.greatest(zero, F.least(side, x2) - F.greatest(zero, x1)) * F.greatest(zero, F.least(side, y2) - F.greatest(zero, y1))
    return F.struct(F.array(x1, y1, x2, y2).alias("box"), F.try_divide(seen, (x2 - x1) * (y2 - y1)).alias("visible"))


def visibility_group(visible) -> Column:
    return F.when(col(visible) == 0, "invisible").when(col(visible) < 1 - 1e-8, "partial").otherwise("full")


def patches(box, crop: int = 224, side: int = 14) -> Column:
    """Numbers of the patches of a square grid whose centre lies in a box; if none does, the patch nearest to its centre, moved into the grid.  Columns and rows are told apart, and the box is worked out once."""
    b, step = col(box), crop / side
    every = F.sequence(F.lit(0), F.lit(side * side - 1))

    def cx(p):
        return (p % side + 0.5) * step

    def cy(p):
        return (F.floor(p / side) + 0.5) * step

    def within(x):
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(float(crop)))

    def along(low, high):
        return F.filter(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: ((k + 0.5) * step >= low) & ((k + 0.5) * step < high))

    def nearest(m):
        return F.array_min(F.transform(every, lambda p: F.struct((F.pow(cx(p) - m[0], 2) + F.pow(cy(p) - m[1], 2)).alias("d"), p.alias("p"))))["p"]

    def of(b):
        inside = bound(along(b[0], b[2]), lambda xs: F.flatten(F.transform(along(b[1], b[3]), lambda y: F.transform(xs, lambda x: y * side + x))))
        middle = F.array(within((b[0] + b[2]) / 2.0), within((b[1] + b[3]) / 2.0))
        return bound(inside, lambda i: F.when(F.size(i) > 0, i).otherwise(F.array(bound(middle, nearest))))

    return bound(b, of)


def feature_vector(boxes, width, height) -> Column:
    """x1, y1, x2, y2 of the first box and the total area in shares of the image, and half the number of boxes."""
    bs = col(boxes)
    x = F.get(bs, F.lit(0))
    w, h = col(width).cast("double"), col(height).cast("double")
    some = F.array(x[0] / w, x[1] / h, x[2] / w, x[3] / h, total_area(bs) / (w * h), F.size(bs) / 2.0)
    return F.when(F.size(bs) > 0, some).otherwise(F.array(*[F.lit(0.0)] * 6))


def one_hot(c, names: list[str]) -> Column:
    return F.array(*[F.when(col(c) == n, 1.0).otherwise(0.0) for n in names])
