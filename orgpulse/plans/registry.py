"""Model registry: each model is a function with tags; tags drive the Silver unions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Model:
    name: str
    tags: frozenset[str]
    build: Callable[[], DataFrame]


@dataclass
class Registry:
    models: list[Model] = field(default_factory=list)

    def add(self, name: str, tags: set[str], build: Callable[[], DataFrame]) -> "Registry":
        self.models.append(Model(name, frozenset(tags), build))
        return self

    def tagged(self, tag: str) -> list[Model]:
        return [m for m in self.models if tag in m.tags]


class TableMissing(LookupError):
    """The table a model reads isn't there yet."""


def table_model(spark, name: str) -> Callable[[], DataFrame]:
    """Build function of a stored table; a table that does not exist yet is skipped by the union."""

    def build() -> DataFrame:
        if not spark.catalog.tableExists(name):
            raise TableMissing(name)
        return spark.table(name)

    return build


def union_by_tag(registry: Registry, tag: str) -> DataFrame:
    """UNION ALL by column name of every model with the tag.

    A model whose table is missing raises ``TableMissing`` in its build function
    and is skipped, any other error is raised; columns absent from one model become NULL.
    """
    parts = []
    for model in registry.tagged(tag):
        try:
            parts.append(model.build())
        except TableMissing:
            continue
    if not parts:
        raise ValueError(f"no model with tag {tag!r} could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# The Silver classes fed by tags.
GIT_CLASSES = [
    "class_git_repositories",
    "class_git_repository_branches",
    "class_git_commits",
    "class_git_file_changes",
    "class_git_pull_requests",
    "class_git_pull_requests_reviewers",
    "class_git_pull_requests_comments",
    "class_git_pull_requests_commits",
]
COLLAB_CLASSES = [
    "class_collab_chat_activity",
    "class_collab_meeting_activity",
    "class_collab_email_activity",
    "class_collab_document_activity",
    "class_comms_events",
]
HR_CLASSES = ["class_hr_events", "class_hr_working_hours", "class_people"]
CRM_CLASSES = [
    "class_crm_accounts",
    "class_crm_contacts",
    "class_crm_deals",
    "class_crm_activities",
    "class_crm_users",
]
AI_CLASSES = ["class_ai_dev_usage"]
IDENTITY_CLASSES = ["bootstrap_inputs"]
