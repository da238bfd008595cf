from martflow.plans.incremental import (
    check_schema,
    incremental_append,
    incremental_merge,
    missing_rows,
)
from martflow.plans.models import Context, Project
from martflow.plans.projects import listings_project, shop_project
from martflow.plans import jobs, marts

__all__ = [
    "Context",
    "Project",
    "check_schema",
    "incremental_append",
    "incremental_merge",
    "missing_rows",
    "jobs",
    "listings_project",
    "marts",
    "shop_project",
]
