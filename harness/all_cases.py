"""Imports every family so that its cases register."""

from harness import bindings, flow_cases, git_cases, identity_cases, metric_cases, stream_cases, work_cases  # noqa: F401
from harness.cases import CASES, SQL, oracle_text  # noqa: F401
