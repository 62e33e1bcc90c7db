"""Clips as array<float> columns with samples in [-1, 1]."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from echoscore import constants as K


def _mean_square(clip: Column) -> Column:
    squares = F.aggregate(
        clip, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.try_divide(squares, F.size(clip))


def rms(clip: Column) -> Column:
    """Root mean square level; NULL for an empty clip."""
    return F.sqrt(_mean_square(clip))


def dbfs(clip: Column) -> Column:
    """Level in dB relative to full scale; NULL for a silent or empty clip."""
    level = rms(clip)
    return F.when(level > 0, 20 * F.log10(level))


def usable(clip: Column) -> Column:
    """Whether a clip can be mixed: not empty, every sample finite, not silent."""
    finite = F.forall(clip, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(clip) > 0) & finite & (rms(clip) > 0), F.lit(False))


def noise_gain(main: Column, noise: Column, multiplier: float = K.NOISE_MULTIPLIER) -> Column:
    """Linear gain that brings the noise to the main clip's level times ``multiplier``.

    A multiplier of 0 or less mutes the noise by 100 dB instead.
    """
    factor = multiplier if multiplier > 0 else 10 ** (K.MUTED_DB / 20)
    return F.try_divide(rms(main), rms(noise)) * factor


def mix(main: Column, noise: Column, gain: Column) -> Column:
    """Main clip plus the looped, scaled noise, limited to [-1, 1]; NULL unless both clips are usable."""
    # transform over one-element arrays names size and gain once per row, not once per sample
    mixed = F.transform(
        F.array(F.struct(gain.alias("g"), F.size(noise).alias("n"))),
        lambda k: F.transform(
            main,
            lambda x, i: F.greatest(
                F.lit(-1.0),
                F.least(
                    F.lit(1.0),
                    x.cast("double") + k["g"] * F.element_at(noise, (i % k["n"]).cast("int") + 1),
                ),
            ).cast("float"),
        ),
    )[0]
    return F.when(usable(main) & usable(noise) & gain.isNotNull(), mixed)


def insert_silence(clip: Column, n: Column | int, position: Column) -> Column:
    """Put ``n`` zero samples in front of, in the middle of or behind a clip."""
    n = F.lit(n) if isinstance(n, int) else n
    gap = F.array_repeat(F.lit(0.0).cast("float"), n)
    half = F.floor(F.size(clip) / 2).cast("int")
    cut = (
        F.when(position == "front", F.lit(0))
        .when(position == "middle", half)
        .when(position == "back", F.size(clip))
        .otherwise(F.raise_error(F.concat(F.lit("unknown position: "), F.coalesce(position, F.lit("NULL")))))
        .cast("int")
    )
    return F.concat(F.slice(clip, 1, cut), gap, F.slice(clip, cut + 1, F.size(clip)))
