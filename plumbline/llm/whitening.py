"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.shared import share
from plumbline.sources.storage import store

SCALE = 64
ORIGIN = 1_000_000
COMPONENTS = 32
LIMB = 60  # bits of a limb of an exact sum
DIGITS = 60  # of the decimal numbers in which components are sought
ROOT_BITS = 100  # leading bits to which an eigenvalue is known
LARGEST = 1 << 62
START_PRIME = (1 << 31) - 1  # moduli are primes from here downwards: products of two residues fit 64 bits


def whole_vectors(embeddings: DataFrame, scale: int = SCALE, origin: int = ORIGIN) -> DataFrame:
    """(vec_id, vector of floor(scale * x) + origin) of the rows whose vector holds only finite numbers.

    Null vectors and those with a null, NaN or infinite entry are left out. Entries that a long cannot
    hold count as 2**62 of their sign.
    """
    def whole(x: Column) -> Column:
        scaled = F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale)))
        return scaled.cast("bigint") + F.lit(origin).cast("bigint")

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != math.inf))
    return embeddings.filter(F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", whole).alias("vector"))


def _matrix(vectors: pa.ListArray, width: int, origin: int) -> np.ndarray:
    """Entries less the origin; shorter vectors are followed by entries of the origin itself."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - origin
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _exact_product(rows: np.ndarray, largest: int) -> np.ndarray:
    """rows.T @ rows as whole numbers: in floating point as long as every partial sum is held exactly."""
    if largest * largest > 2**53:
        big = rows.astype(object)
        return big.T @ big
    step, total = max(1, 2**53 // max(1, largest * largest)), np.zeros((rows.shape[1],) * 2, object)
    for start in range(0, len(rows), step):
        part = rows[start:start + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def scatter(vectors: DataFrame, width: int, largest: int, origin: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, G): the number of vectors, the exact sums of their entries less the origin, and of the
    products of two. Each task sends one row for each pair of dimensions and limb."""

    def add(batches):
        count, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            rows = _matrix(batch.column("vector"), width, origin)
            count += len(rows)
            sums = sums + rows.astype(object).sum(axis=0) if largest > 2**31 else sums + rows.sum(axis=0).astype(object)
            products = products + _exact_product(rows, largest)
        cells = [(-1, -1, count), *((-1, j, s) for j, s in enumerate(sums))]
        cells += [(i, j, products[i, j]) for i in range(width) for j in range(i, width)]
        limbs = []
        for i, j, value in cells:
            value, limb = int(value), 0
            while value:
                rest = value >> LIMB
                part = value if rest in (0, -1) else value & ((1 << LIMB) - 1)
                limbs.append((i, j, limb, part))
                value, limb = 0 if rest in (0, -1) else rest, limb + 1
        columns = list(zip(*limbs)) or [(), (), (), ()]
        yield pa.record_batch(
            [pa.array(columns[c], pa.int32()) for c in range(3)] + [pa.array(columns[3], pa.int64())], names=["i", "j", "limb", "value"]
        )

    parts = vectors.select("vector").mapInArrow(add, "i int, j int, limb int, value bigint")
    summed = parts.groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    count, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for i, j, limb, value in summed:
        value = int(value) << (LIMB * limb)
        if j < 0:
            count += value
        elif i < 0:
            sums[j] += value
        else:
            products[i][j] += value
            if i != j:
                products[j][i] += value
    return count, sums, products


def primes_below(start: int, product_over: int) -> list[int]:
    """The largest primes up to ``start`` whose product is over a bound."""
    found, product, candidate = [], 1, start
    while product <= product_over:
        if _is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def _is_prime(number: int) -> bool:
    """Miller and Rabin with bases that decide every number below 3,215,031,751."""
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        power = pow(base, odd, number)
        if power in (1, number - 1):
            continue
        for _ in range(twos - 1):
            power = power * power % number
            if power == number - 1:
                break
        else:
            return False
    return True


def polynomial_modulo(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Coefficients of det(x I - matrix), highest power first, modulo a prime below 2**31."""
    a, size = matrix.copy(), len(matrix)
    for k in range(1, size - 1):  # to Hessenberg form, by similarity
        filled = np.flatnonzero(a[k:, k - 1])
        if not len(filled):
            continue
        pivot = k + int(filled[0])
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            a[:, [k, pivot]] = a[:, [pivot, k]]
        factors = a[k + 1:, k - 1] * pow(int(a[k, k - 1]), -1, prime) % prime
        a[k + 1:] = (a[k + 1:] - factors[:, None] * a[k] % prime) % prime
        a[:, k] = (a[:, k] + (a[:, k + 1:] * factors % prime).sum(axis=1)) % prime
    minors = np.zeros((size + 1, size + 1), np.int64)  # row k: the polynomial of the leading k rows, lowest power first
    minors[0, 0] = 1
    for k in range(1, size + 1):
        row = np.zeros(size + 1, np.int64)
        row[1:] = minors[k - 1, :-1]
        row = (row - a[k - 1, k - 1] * minors[k - 1]) % prime
        path, weights = 1, np.zeros(max(k - 1, 0), np.int64)
        for i in range(k - 1, 0, -1):
            path = path * int(a[i, i - 1]) % prime
            weights[i - 1] = path * int(a[i - 1, k - 1]) % prime
        if k > 1:
            row = (row - (weights[:, None] * minors[:k - 1] % prime).sum(axis=0)) % prime
        minors[k] = row
    return minors[size, ::-1]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x I - matrix), highest power first, of a positive semidefinite matrix.

    The elementary symmetric sums of its eigenvalues are bounded by (1 + trace / size) ** size. Residues
    modulo enough primes are found in tasks, a prime a row, and joined by Chinese remainders.
    """
    size, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    primes = primes_below(START_PRIME, 2 * (-(-(trace + size) // size)) ** size)
    held = share(spark, matrix)

    def residues(batches):
        whole = np.array(held(), object)
        for batch in batches:
            for prime in batch.column("prime").to_pylist():
                found = polynomial_modulo((whole % prime).astype(np.int64), prime)
                yield pa.record_batch({"prime": pa.array([prime]), "residues": pa.array([found.tolist()], pa.list_(pa.int64()))})

    tasks = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(min(len(primes), 64), "prime")
    rows = tasks.mapInArrow(residues, "prime bigint, residues array<bigint>").collect()
    product = math.prod(primes)
    weights = {p: product // p * pow(product // p, -1, p) for p in primes}
    found = [sum(r["residues"][k] * weights[r["prime"]] for r in rows) % product for k in range(size + 1)]
    return [c - product if 2 * c > product else c for c in found]


def _roots_above(polynomial: list[int], at: int) -> int:
    """How many roots are greater: the sign changes of the polynomial moved to ``at``. With real roots only
    Descartes' rule counts exactly, repeated roots as often as they occur."""
    moved = list(polynomial)
    for stop in range(len(moved) - 1, 0, -1):
        for k in range(1, stop + 1):
            moved[k] += at * moved[k - 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(polynomial: list[int], at: int) -> int:
    value = 0
    for c in polynomial:
        value = value * at + c
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], most: int) -> tuple[int, list[tuple[int, int]]]:
    """(shift, [(root times 2**shift, multiplicity)]): the largest positive roots of a polynomial that has
    only real roots, none negative, by falling size, to ``ROOT_BITS`` leading bits.

    Intervals are halved and their roots counted until each holds one root, or roots that agree in
    all these bits; single roots are then narrowed by sign.
    """
    end = len(polynomial)
    while end > 1 and polynomial[end - 1] == 0:
        end -= 1
    poly = polynomial[:end]
    if len(poly) == 1:
        return 0, []
    # The least root is at least the ratio of the last two coefficients.
    least = Fraction(abs(poly[-1]), abs(poly[-2]) or 1)
    shift = max(0, ROOT_BITS + 8 - (least.numerator.bit_length() - least.denominator.bit_length()))
    poly = [c << (shift * k) for k, c in enumerate(poly)]
    top = abs(poly[1]) + 1 if len(poly) > 1 else 1
    found, taken = [], 0
    stack = [(0, top, len(poly) - 1, 0)]  # above low, up to high; roots above low, above high
    while stack and taken < most:
        low, high, over_low, over_high = stack.pop()
        inside = over_low - over_high
        if not inside:
            continue
        if inside == 1 or high - low <= max(1, high >> ROOT_BITS):
            found.append((_narrowed(poly, low, high) if inside == 1 else high, inside))
            taken += inside
            continue
        middle = (low + high) // 2
        over = _roots_above(poly, middle)
        stack += [(low, middle, over_low, over), (middle, high, over, over_high)]
    return shift, found


def _narrowed(poly: list[int], low: int, high: int) -> int:
    """The one root in (low, high], rounded up."""
    above = _sign(poly, high)
    if above == 0:
        return high
    while high - low > max(1, high >> ROOT_BITS):
        middle = (low + high) // 2
        sign = _sign(poly, middle)
        if sign == 0:
            return middle
        low, high = (low, middle) if sign == above else (middle, high)
    return high


def null_vectors(matrix: list[list[int]], root: int, shift: int, count: int) -> list[list[float]]:
    """``count`` orthogonal unit vectors that the matrix, times 2**shift and less ``root`` on its diagonal,
    takes nearly to zero: inverse iteration on one factorisation in decimals of ``DIGITS`` digits."""
    with localcontext() as context:
        context.prec = DIGITS
        size = len(matrix)
        a = np.array([[Decimal(v << shift) for v in row] for row in matrix], object)
        for i in range(size):
            a[i, i] = Decimal((matrix[i][i] << shift) - root)
        tiny = max(Decimal(root), Decimal(1)) * Decimal(10) ** (10 - DIGITS)
        order = np.arange(size)
        for k in range(size):
            pivot = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
            if pivot != k:
                a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < size:
                a[k + 1:, k] = a[k + 1:, k] / a[k, k]
                a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - a[k + 1:, k][:, None] * a[k, k + 1:]

        def unit(v):
            for other in found:
                v = v - other * (v @ other)
            return v / (v @ v).sqrt()

        found: list[np.ndarray] = []
        for number in range(count):
            v = unit(np.array([Decimal(1 + (i * (7 + 4 * number) + number) % 11) + Decimal(i + 1) / 97 for i in range(size)], object))
            for _ in range(3):
                v = v[order]
                for k in range(1, size):
                    v[k] = v[k] - a[k, :k] @ v[:k]
                for k in range(size - 1, -1, -1):
                    rest = a[k, k + 1:] @ v[k + 1:] if k + 1 < size else 0
                    v[k] = (v[k] - rest) / a[k, k]
                v = unit(v)
            found.append(v)
        vectors = [[float(x) for x in v] for v in found]
    return [[-x for x in v] if max(v, key=abs) < 0 else v for v in vectors]


def principal_components(
    spark: SparkSession, matrix: list[list[int]], most: int
) -> tuple[list[Fraction], list[list[float]]]:
    """The largest positive eigenvalues of an integer matrix and their unit eigenvectors; equal
    eigenvalues are listed as often as they occur. Each root's vectors are sought by one task."""
    common = math.gcd(*(v for row in matrix for v in row)) if matrix else 0
    if not common:
        return [], []
    small = [[v // common for v in row] for row in matrix]
    shift, roots = largest_roots(characteristic_polynomial(spark, small), most)
    jobs, values = [], []
    for root, times in roots:
        take = min(times, most - len(values))
        jobs.append((len(values), str(root), take))
        values += [Fraction(root * common, 1 << shift)] * take
    held = share(spark, small)

    def seek(batches):
        for batch in batches:
            for job in batch.to_pylist():
                for step, vector in enumerate(null_vectors(held(), int(job["root"]), shift, job["take"])):
                    yield pa.record_batch({"place": pa.array([job["place"] + step], pa.int32()), "vector": pa.array([vector], pa.list_(pa.float64()))})

    tasks = spark.createDataFrame(jobs, "place int, root string, take int").repartition(len(jobs), "place")
    rows = tasks.mapInArrow(seek, "place int, vector array<double>").collect()
    return values, [r["vector"] for r in sorted(rows, key=lambda r: r["place"])]


def _deviations(rows: np.ndarray, count: int, sums: list[int], largest: int) -> tuple[np.ndarray, list[str]]:
    """(n * x - S, exact sums of its squares as texts)."""
    if 4 * rows.shape[1] * (count * largest) ** 2 < 2**63:
        offsets = count * rows - np.array(sums, np.int64)
        return offsets, (offsets * offsets).sum(axis=1).astype(str).tolist()
    offsets = count * rows.astype(object) - np.array(sums, object)
    return offsets, [str(v) for v in (offsets * offsets).sum(axis=1)]


def whitened_vectors(
    vectors: DataFrame, components: int = COMPONENTS, origin: int = ORIGIN
) -> tuple[DataFrame, list[float], int]:
    """(table, explained shares, n) of whole-number vectors with a ``vec_id``.

    The table has vec_id, ``deviation`` (decimal: the exact sum of (n * x - S) ** 2) and ``whitened``, the
    centred vector on each component over the root of its eigenvalue. All vectors are the fit list.
    Components of eigenvalue 0 do not exist, so vectors without spread (one vector, equal ones) give
    empty lists. Repeated ids and equal vectors stay rows of their own; shorter vectors are followed by
    entries of ``origin``. The driver holds matrices of the width squared, whatever the number of rows.
    """
    spark = vectors.sparkSession
    distance = F.array_max(F.transform("vector", lambda x: F.abs(x - F.lit(origin))))
    facts = vectors.agg(F.max(F.size("vector")), F.max(distance)).first()
    width, largest = facts[0] or 0, int(facts[1] or 0)
    count, sums, products = scatter(vectors, width, largest, origin) if width else (vectors.count(), [], [])
    matrix = [[count * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    values, axes = principal_components(spark, matrix, components)
    trace = sum(matrix[i][i] for i in range(width))
    with localcontext() as context:
        context.prec = DIGITS
        roots = [float((Decimal(v.numerator) / Decimal(v.denominator)).sqrt() / count) for v in values]
    held = share(spark, (sums, np.array(axes, np.float64).reshape(len(axes), width), np.array(roots)))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def project(batches):
        own_sums, own_axes, own_roots = held()
        for batch in batches:
            offsets, squares = _deviations(_matrix(batch.column("vector"), width, origin), count, own_sums, largest)
            white = (offsets.astype(np.float64) / count) @ own_axes.T / own_roots
            listed = pa.ListArray.from_arrays(np.arange(0, white.size + 1, max(1, white.shape[1]), dtype=np.int32)[:len(white) + 1]
                                              if white.shape[1] else np.zeros(len(white) + 1, np.int32), pa.array(white.ravel()))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "deviation": pa.array(squares, pa.string()), "whitened": listed})

    found = vectors.select("vec_id", "vector").mapInArrow(project, f"vec_id {kind}, deviation string, whitened array<double>")
    table = found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    return store(table, "whitened"), [float(v / trace) for v in values], count


def identity_error(whitened: DataFrame, components: int, count: int) -> float:
    """The largest absolute entry of the whitened columns' covariance less the identity."""
    if not components:
        return 0.0

    def add(batches):
        sums, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            rows = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
            sums, products = sums + rows.sum(axis=0), products + rows.T @ rows
        i, j = np.triu_indices(components)
        yield pa.record_batch({
            "i": pa.array(np.append(np.full(components, -1), i), pa.int32()),
            "j": pa.array(np.append(np.arange(components), j), pa.int32()), "value": pa.array(np.append(sums, products[i, j])),
        })

    parts = whitened.select("whitened").mapInArrow(add, "i int, j int, value double")
    cells = {(r["i"], r["j"]): r["value"] / count for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    return max(
        abs(cells[i, j] - cells[-1, i] * cells[-1, j] - (1.0 if i == j else 0.0))
        for i in range(components) for j in range(i, components)
    )


def whitening_table(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component; a deviation beyond a long is null in ``deviation`` and whole in
    ``deviation_exact``."""
    table, explained, count = whitened_vectors(whole_vectors(embeddings), components)
    error = identity_error(table, len(explained), count)
    shares = F.array(*[F.lit(s) for s in explained]) if explained else F.array().cast("array<double>")
    each = table.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(count).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"), "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )
