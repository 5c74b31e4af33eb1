"""Run settings. Credentials never live here: callers pass them as reader options."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AlsConfig:
    """Training settings; ``small()`` is the variant for little memory."""

    rank: int = 30
    reg_param: float = 0.1
    max_iter: int = 10
    top_n: int = 30
    max_user_id: int | None = None  # a bound trains on the users with the lowest ids only
    # Tasks of a training step; None: one for every ``block_ratings`` ratings or ``block_bytes`` of factors, 10 at least. Every
    # block is sent each factor it needs, so more blocks than memory asks for move more. A block is put together from some 40
    # bytes a rating, then it holds the factors it is sent; a task has to have room for either.
    blocks: int | None = None
    block_ratings: int = 6_000_000
    block_bytes: int = 512_000_000
    # Iterations after which the shuffles of earlier ones are deleted.
    checkpoint_interval: int = 1
    seed: int = 42
    algorithm: str = "ALS"
    exclude_seen: bool = False  # leave out what a user has rated

    @staticmethod
    def small() -> "AlsConfig":
        return AlsConfig(rank=10, reg_param=0.3, max_iter=5, top_n=20)


@dataclass(frozen=True)
class JdbcConfig:
    """Stride settings of the partitioned rating read; the bounds should be the least and greatest value."""

    lower: int
    upper: int
    column: str = "userId"
    partitions: int = 40
    fetchsize: int = 10000


@dataclass(frozen=True)
class StreamConfig:
    """Settings shared by the two ingest streams."""

    watermark: str = "10 minutes"
    trigger: str = "10 seconds"
    ratings_topic: str = "ratings"
    items_topic: str = "movies"
    starting_offsets: str = "latest"
    dedup: str = "latest"
