"""All registered queries of the engine's own operators, and their reference SQL."""

from __future__ import annotations

from orelode.plans import kernels, more_kernels

QUERIES = {**kernels.QUERIES, **more_kernels.QUERIES}
ORACLES = {**kernels.ORACLES, **more_kernels.ORACLES}
