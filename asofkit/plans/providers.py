"""Feature-provider plug-ins: any function from requests to keyed features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from asofkit.operators.joins import snapshot
from asofkit.requests import Requests

Provider = Callable[[Requests], DataFrame]


def attach(requests: Requests, *providers: Provider) -> DataFrame:
    """Join each provider's columns at exactly (entity, cutoff).

    Column clashes are refused when the plan is built; providers return one row
    per key, which ``snapshot_violations`` reports on.
    """
    frame = requests.frame
    for provider in providers:
        current = Requests(frame, requests.cutoffs, requests.phase)
        frame = snapshot(current, provider(current))
    return frame
