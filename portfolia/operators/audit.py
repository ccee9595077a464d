"""Reading the audit log: checked arguments, optional filters, a keyset cursor, payloads without what is hidden."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.operators.rules import sanitized
from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables


@dataclass(frozen=True)
class AuditQuery:
    """The nine arguments of a read; blank texts are as if they weren't given."""

    limit: int | None = 100
    after_changed_at: datetime | None = None
    after_id: int | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    entity: str | None = None
    operation: str | None = None
    actor: int | None = None
    request_id: str | None = None

    def checked(self) -> AuditQuery:
        """The arguments with texts trimmed; ValueError where one is out of its range."""
        entity, request_id = ((text or "").strip(" ") or None for text in (self.entity, self.request_id))
        refusals = [
            (self.limit is None or not 1 <= self.limit <= 200, "limit must be from 1 to 200"),
            ((self.after_changed_at is None) != (self.after_id is None), "a cursor has both changed_at and id"),
            (self.date_from is not None and self.date_to is not None and self.date_from > self.date_to, "the range of dates ends before it begins"),
            (entity is not None and not re.fullmatch(r"ltc_m\.[a-z_]+", entity), "not the name of an entity"),
            (request_id is not None and len(request_id) > 200, "a request id has 200 characters at most"),
        ]
        for bad, text in refusals:
            if bad:
                raise ValueError(text)
        return AuditQuery(**asdict(self) | {"entity": entity, "request_id": request_id})


def read_audit(log: DataFrame, asked: AuditQuery, role: str | None) -> DataFrame:
    """A page of the log, newest first, for admins only; old and new data lose what the audit of their table hides.

    ``log``: id, table_name, record_id, operation, old_data and new_data (maps of
    text), changed_by_user_id, request_id, changed_at.  Filters that are not given
    are no part of the plan; those that are reach the scan.
    """
    if role != "admin":
        raise PermissionError("reading the audit takes an active admin")
    asked = asked.checked()
    moment = lambda v: F.lit(None if v is None else v.isoformat(" ")).cast(log.schema["changed_at"].dataType)
    after, at = moment(asked.after_changed_at), F.col("changed_at")
    tests = {
        "date_from": at >= moment(asked.date_from), "date_to": at <= moment(asked.date_to), "entity": F.col("table_name") == F.lit(asked.entity), "operation": F.col("operation") == F.lit(asked.operation),
        "actor": F.col("changed_by_user_id") == F.lit(asked.actor), "request_id": F.col("request_id") == F.lit(asked.request_id), "after_id": (at < after) | ((at == after) & (F.col("id") < F.lit(asked.after_id))),
    }
    rows = log
    for name, test in tests.items():
        if getattr(asked, name) is not None:
            rows = rows.where(test)
    bare = F.split_part("table_name", F.lit("."), F.lit(2))
    shown = {c: sanitized(bare, F.col(c)) for c in ("old_data", "new_data")}
    return rows.orderBy(F.col("changed_at").desc(), F.col("id").desc()).limit(asked.limit).withColumns(shown)


def access_event(asked: AuditQuery, actor: int) -> dict:
    """What the log is to say of a read: an operation of its own with all arguments as its metadata."""
    checked = asdict(asked.checked())
    told = {("request_id_filter" if k == "request_id" else k): None if v is None else str(v) for k, v in checked.items()}
    return {"table_name": "ltc_m.audit_log", "record_id": str(actor), "operation": "AUDIT_READ", "metadata": told}


def audit_log(t: Tables) -> DataFrame:
    """The test table's events as rows of a log with tables, actors, requests and data."""
    n = F.col("id")
    names = F.array(*map(F.lit, ["ltc_m.app_users", "ltc_m.clients", "ltc_m.financial_actual_events", "ltc_m.import_batches", "ltc_m.projects"]))
    data = F.create_map(F.lit("id"), n.cast("string"), F.lit("tax_id"), F.lit("t"), F.lit("notes"), F.col("operation"))
    return t.audit.select(
        "id", F.element_at(names, (n % 5 + 1).cast("int")).alias("table_name"), F.col("entity_id").cast("string").alias("record_id"), "operation", F.when(n % 2 == 0, data).alias("old_data"), data.alias("new_data"),
        (n % 3).alias("changed_by_user_id"), F.when(n % 4 > 0, F.concat(F.lit("r"), (n % 4).cast("string"))).alias("request_id"), F.col("changed_at").cast("timestamp_ntz").alias("changed_at"),
    )


@query("""SELECT id, 'ltc_m.clients' AS table_name, entity_id::VARCHAR AS record_id, operation, CASE WHEN id % 2 = 0 THEN 'id,notes' END AS old_fields, 'id,notes' AS new_fields FROM audit
WHERE id % 5 = 1 AND id % 3 = 1 AND id % 4 = 2 AND changed_at >= TIMESTAMP '2024-01-05' AND changed_at <= TIMESTAMP '2024-01-28' AND (changed_at, id) < (TIMESTAMP '2024-01-25', 10) ORDER BY changed_at DESC, id DESC LIMIT 150""")
def g10_filtered_audit(t: Tables) -> DataFrame:
    """A page of an admin's read with a cursor and filters by date, entity, actor and request."""
    asked = AuditQuery(150, datetime(2024, 1, 25), 10, datetime(2024, 1, 5), datetime(2024, 1, 28), " ltc_m.clients ", None, 1, "r2")
    fields = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    return read_audit(audit_log(t), asked, "admin").select("id", "table_name", "record_id", "operation", fields("old_data").alias("old_fields"), fields("new_data").alias("new_fields"))
