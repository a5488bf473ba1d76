"""ST4: the settings that a checkpoint's state was written with.

A restarted query goes on with the state in its checkpoint, and some
settings are part of that state: the salt count is in its join keys, the
window, the slide and the watermark decide what it holds.  Started with
others, Spark raises nothing; records that wait for their window never
meet it.  So the settings lie beside Spark's own files in the checkpoint
and a start compares:

* a setting that changes no result (``KEPT``) goes on as it was written,
  whatever the new configuration says;
* one that changes results (``FIXED``) must be the same, or the start is
  refused with a message that names it.

A checkpoint without a committed batch holds no state: it takes the new
settings.  One with batches but no record is refused, unless
``adopt_settings`` says that the settings given are those it was written
with.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from ..operators.reputation import parse_duration
from ..sources import publish

log = logging.getLogger(__name__)

RECORD = "_veracity/settings.json"
FIXED = ("reputation_mode", "window_seconds", "slide_seconds",
         "watermark_seconds", "output_mode")
KEPT = ("reputation_salts",)


class SettingsChanged(ValueError):
    """A checkpoint's state was written with other settings."""


@dataclass(frozen=True)
class StateSettings:
    reputation_mode: str
    window_seconds: int
    slide_seconds: int
    watermark_seconds: int
    output_mode: str
    reputation_salts: int

    @classmethod
    def of(cls, config) -> "StateSettings":
        return cls(config.reputation_mode,
                   parse_duration(config.window_duration),
                   parse_duration(config.sliding_duration),
                   parse_duration(config.watermark_delay),
                   config.output_mode.lower(), config.reputation_salts)


def has_batches(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the checkpoint has the log of a batch."""
    return any(n.isdigit() for n in publish.names(spark,
                                                  f"{checkpoint}/offsets"))


def settle(spark: SparkSession, config, adopt_settings: bool = False):
    """The configuration to run with on its checkpoint: ``config`` with
    kept settings as they were written.  Raises ``SettingsChanged`` for
    fixed ones that differ, and leaves the checkpoint as it is then."""
    path = f"{config.checkpoint_dir}/{RECORD}"
    now = StateSettings.of(config)
    started = has_batches(spark, config.checkpoint_dir)
    held = publish.read_json(spark, path) if started else None
    if held is None:
        if started and not adopt_settings:
            raise SettingsChanged(
                f"{config.checkpoint_dir} has batches but no record of its "
                "settings; start with adopt_settings if they are the same")
        publish.write_json(spark, path, vars(now))
        return config
    other = [f"{k}: {held.get(k)!r} there, {getattr(now, k)!r} given"
             for k in FIXED if held.get(k) != getattr(now, k)]
    if other:
        raise SettingsChanged(
            f"the state in {config.checkpoint_dir} was written with other "
            f"settings ({'; '.join(other)}); restore them or start on a "
            "new checkpoint")
    for k in KEPT:
        if held[k] != getattr(config, k):
            log.warning("%s stays %s, as the state in %s has it (given: %s)",
                        k, held[k], config.checkpoint_dir, getattr(config, k))
    return replace(config, **{k: held[k] for k in KEPT})
