"""When a build deals its records to more tasks than they come in."""

from __future__ import annotations

#: No number of records is above it: parallel builds are asked for, not assumed.
THRESHOLD = 2**31 - 1


def can_use_parallel(cpus: int) -> bool:
    return cpus > 1


def degree_of_parallelism(cpus: int) -> int:
    """Three quarters of the processors, two at least; one on a machine with one."""
    return max(2, cpus * 3 // 4) if can_use_parallel(cpus) else 1


def should_use_parallel(cpus: int, force: bool, count: int, threshold: int = THRESHOLD) -> bool:
    return can_use_parallel(cpus) and (force or count > threshold)
