"""Oracles of the streaming jobs: the batch jobs' SQL (batch = stream)."""

from vendorlytics.plans.oracle_billing import ORACLES as _B

ORACLES = {
    "billing_stream_state": _B["subscription_state"],
    "rate_limit_stream": _B["rate_limit_violations"],
}
