"""The volume model: sizes, levels, atoms, regions, and their tables."""

from __future__ import annotations

from dataclasses import dataclass

ATOM = 32
REGION = 32
CHUNK = 256
BLOCK = 16
MOST_LODS = 8
MOST_DIM = 1 << 20
LEAST_Q, MOST_Q = 0.05, 4096.0

ABSENT, KNOWN_ZERO, PRESENT = 0, 1, 2

VOXELS = "volume string, lod tinyint, z int, y int, x int, v smallint"
ATOMS = "volume string, lod tinyint, az int, ay int, ax int, vox binary"
CODED_ATOMS = "volume string, lod tinyint, az int, ay int, ax int, cover tinyint, dc smallint, q double, payload binary, ingest_id long"
ZERO_REGIONS = "volume string, lod tinyint, rz int, ry int, rx int"
VOLUME_META = "volume string, nx int, ny int, nz int, nlod int, target_ratio double, base_q array<double>, codec string, metadata string"


@dataclass(frozen=True)
class Extent:
    """Sizes of any grid of voxels; its levels, atoms and regions."""

    nx: int
    ny: int
    nz: int

    def __post_init__(self) -> None:
        if not all(1 <= d for d in (self.nx, self.ny, self.nz)):
            raise ValueError(f"each size is 1 or more: {self}")

    def half(self) -> Extent:
        return type(self)(*((d + 1) // 2 for d in (self.nx, self.ny, self.nz)))

    def lod(self, k: int) -> Extent:
        return self if k == 0 else self.half().lod(k - 1)

    @property
    def n_lods(self) -> int:
        """Levels until all sizes are 1, eight at most."""
        n, d = 1, self
        while n < MOST_LODS and max(d.nx, d.ny, d.nz) > 1:
            n, d = n + 1, d.half()
        return n

    def atoms(self) -> tuple[int, int, int]:
        """(z, y, x) atoms."""
        return tuple(-(-d // ATOM) for d in (self.nz, self.ny, self.nx))

    def regions(self) -> tuple[int, int, int]:
        """(z, y, x) regions."""
        return tuple(-(-a // REGION) for a in self.atoms())


@dataclass(frozen=True)
class Dims(Extent):
    """Sizes of a volume that is stored: its atoms have addresses of 15 bits an axis."""

    def __post_init__(self) -> None:
        if not all(1 <= d <= MOST_DIM for d in (self.nx, self.ny, self.nz)):
            raise ValueError(f"each size lies between 1 and {MOST_DIM}: {self}")


@dataclass(frozen=True)
class Box:
    """Half-open: from x0 up to x1."""

    x0: int
    y0: int
    z0: int
    x1: int
    y1: int
    z1: int

    def within(self, dims: Dims) -> Box:
        if not (0 <= self.x0 < self.x1 <= dims.nx and 0 <= self.y0 < self.y1 <= dims.ny and 0 <= self.z0 < self.z1 <= dims.nz):
            raise ValueError(f"{self} is empty or not within {dims}")
        return self

    def aligned(self) -> Box:
        if any(v % ATOM for v in (self.x0, self.y0, self.z0, self.x1, self.y1, self.z1)):
            raise ValueError(f"{self} isn't made of whole atoms")
        return self


def checked_q(q: float) -> float:
    """A quantiser step in its range."""
    return min(max(float(q), LEAST_Q), MOST_Q)


def q_schedule(q0: float, falloff: float, n: int) -> list[float]:
    """q0 * falloff^lod, each floored at the least step before it is multiplied on."""
    out, q = [], float(q0)
    for _ in range(n):
        q = max(q, LEAST_Q)
        out.append(q)
        q *= falloff
    return out
