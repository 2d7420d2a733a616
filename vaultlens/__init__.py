"""Preservation-storage analytics as Spark DataFrame operators.

``sources`` read the storage artefacts with explicit schemas, ``operators``
turn DataFrames into DataFrames, ``sinks`` write reports, ``plans`` join the
three into whole reports and ``streaming`` drives the same operators from
arriving files.
"""

from vaultlens.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
