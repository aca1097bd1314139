"""Every query of the library beside its SQL; importing a module registers what it has."""

from __future__ import annotations

from planegrid.functions import scalar  # noqa: F401
from planegrid.operators import coding, digests, distortion, filters, intervals, intra, loopfilter, pictures, planes, predictors, ratecontrol, references, release, reports, search, shots, statistics, transforms  # noqa: F401
from planegrid.plans.registry import ORACLES, QUERIES  # noqa: F401
from planegrid.sources import annexb, filed, headers, messages, payloads, rawvideo, syntax  # noqa: F401
from planegrid.streaming import buffer, output  # noqa: F401
