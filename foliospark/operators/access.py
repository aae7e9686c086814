"""Users, roles, permissions and ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Permissions of each role.
PERMISSIONS = {
    "user": ("document.upload", "document.view", "document.process", "document.export", "document.delete_own"),
    "admin": (
        "document.upload", "document.view", "document.process", "document.export", "document.delete_own",
        "document.delete_any", "user.manage", "settings.manage", "api.manage",
    ),
    "auditor": ("document.view", "document.export", "audit.view", "report.generate"),
}


def permission_table(spark: SparkSession) -> DataFrame:
    """(role_name, permission), a row for each."""
    return spark.createDataFrame([(r, p) for r, ps in PERMISSIONS.items() for p in ps], "role_name string, permission string")


def effective(user_roles: DataFrame, permissions: DataFrame) -> DataFrame:
    """(user_id, permission), each once."""
    return user_roles.join(permissions, "role_name").select("user_id", "permission").distinct()


def with_permission(users: DataFrame, user_roles: DataFrame, permissions: DataFrame, permission: str) -> DataFrame:
    roles = permissions.where(F.col("permission") == permission)
    return users.join(user_roles.join(roles, "role_name", "left_semi"), "user_id", "left_semi")


def owned(owner: Column, user_id: int | str) -> Column:
    return owner == F.lit(user_id)


def visible(documents: DataFrame, user_roles: DataFrame, user_id: int) -> DataFrame:
    """Documents that a user may see: an admin all, others their own. Whether the user is an admin is one flag, read first, so that the owner reaches the scan."""
    is_admin = not user_roles.where((F.col("user_id") == user_id) & (F.col("role_name") == "admin")).isEmpty()
    return documents if is_admin else documents.where(owned(F.col("uploaded_by"), user_id))


def checked(requested: DataFrame, documents: DataFrame, user_id: int) -> DataFrame:
    """(document_id) with the answer to a batch request: ok, missing or foreign."""
    met = requested.join(documents.select("document_id", "uploaded_by"), "document_id", "left")
    return met.select("document_id", F.when(F.col("uploaded_by").isNull(), "missing").when(F.col("uploaded_by") != user_id, "foreign").otherwise("ok").alias("verdict"))


def new_users(incoming: DataFrame, users: DataFrame) -> DataFrame:
    """Incoming (username, email) of which neither is taken; repeats among the incoming stay for the caller to see."""
    return incoming.join(users.select("username"), "username", "left_anti").join(users.select("email"), "email", "left_anti").select(*incoming.columns)


def live_sessions(sessions: DataFrame, now: str) -> DataFrame:
    return sessions.where(F.col("expires_at") > F.lit(now).cast("timestamp"))
