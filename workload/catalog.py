"""Imports every module that registers queries."""

from workload import views  # noqa: F401, I001
from workload import class_reports  # noqa: F401
from workload import answers  # noqa: F401
from workload import rosters  # noqa: F401
from workload import marks  # noqa: F401
from workload import pages  # noqa: F401
from workload import layout  # noqa: F401
from workload import replies  # noqa: F401
from workload import streams  # noqa: F401
from workload import jobs  # noqa: F401
