"""Condition codes: what an error or event means, and which diagnostic queries belong to it."""

from __future__ import annotations

from ..plans.diagnostics import REGISTERED

# Code, kind and condition.
CODES = {
    "SQL0001": ("error", "instance is already consuming"),
    "SQL0002": ("error", "lifecycle context can never be cancelled"),
    "SQL0003": ("error", "lease lost to another consumer"),
    "SQL0004": ("error", "stream partition size does not match the existing stream"),
    "SQL0005": ("error", "stream not found"),
    "SQL0006": ("error", "stream still holds messages"),
    "SQL0007": ("error", "stream name already taken"),
    "SQL0008": ("error", "destroy is disabled"),
    "SQL0009": ("error", "stream name uses the reserved __system. prefix"),
    "SQL0010": ("error", "a worker instance is still live"),
    "SQL0011": ("error", "streams are still registered"),
    "SQL0012": ("error", "worker instance row expired or was removed"),
    "SQL0013": ("error", "schedule not found"),
    "SQL0014": ("error", "consumer group not found"),
    "SQL0015": ("error", "consumer group still has a live consumer"),
    "SQL0016": ("error", "consumer group still has delivery rows"),
    "SQL0017": ("error", "system not registered"),
    "SQL0018": ("error", "could not create the covering partition"),
    "SQL0019": ("error", "commit confirmation was lost"),
    "SQL0020": ("error", "stream partitions remain after draining"),
    "SQL0021": ("error", "could not finish the stream declaration"),
    "SQL0022": ("error", "schema version is older than this build requires"),
    "SQL0023": ("error", "schema version is newer than this build understands"),
    "SQL0024": ("error", "could not finish the worker declaration"),
    "SQL0025": ("error", "could not finish the schedule declaration"),
    "SQL0026": ("event", "lease reclaimed from expired worker"),
    "SQL0027": ("event", "range quarantined after max reclaims"),
    "SQL0028": ("event", "messages dead-lettered"),
    "SQL0029": ("event", "message dead-lettered"),
    "SQL0030": ("event", "exception dead-lettered"),
    "SQL0031": ("event", "crash-loop kill backstop fired"),
    "SQL0032": ("event", "stored message options outside this consumer's bounds"),
    "SQL0033": ("event", "could not create partition ahead"),
    "SQL0034": ("event", "worker instance lost"),
    "SQL0035": ("event", "manager row suspended"),
    "SQL0036": ("event", "worker tick backoff curve exhausted"),
    "SQL0037": ("event", "schedule message was already produced by an earlier ambiguous commit"),
    "SQL0038": ("event", "produce exceeded the duration threshold"),
    "SQL0039": ("event", "delivery dispatch exceeded the duration threshold"),
    "SQL0040": ("event", "worker tick exceeded its poll rate"),
    "SQL0041": ("event", "consumer stopped"),
    "SQL0052": ("event", "abandoned-routine events dropped"),
    "SQL0053": ("error", "could not take a lock needed by the migration step"),
    "SQL0054": ("error", "could not complete the delivery yet, the handler asked to run it later"),
    "SQL0055": ("error", "delivery cannot succeed"),
    "SQL0056": ("error", "partition creation cannot keep up with the id sequence"),
    "SQL0057": ("event", "no partition covers the next message id"),
    "SQL0058": ("event", "schedule target stream keeps no success rows"),
    "SQL0059": ("event", "worker config replaced"),
    "SQL0060": ("event", "could not refresh group config"),
    "SQL0061": ("event", "stream config replaced"),
    "SQL0062": ("event", "schedule config replaced"),
    "SQL0063": ("event", "alert condition holds"),
    "SQL0064": ("error", "the connecting role cannot create the schema"),
    "SQL0065": ("event", "system manager stopped"),
    "SQL0066": ("error", "compaction head not found"),
    "SQL0097": ("error", "payload cannot be encoded as JSON"),
    "SQL0104": ("event", "measurements cannot be exported"),
    "SQL0105": ("event", "queued message has insufficient lease time"),
    "SQL0106": ("error", "worker not found"),
    "SQL0107": ("error", "worker is suspended"),
    "SQL0108": ("event", "could not claim messages"),
}


class Condition(Exception):
    """An error with its code."""

    def __init__(self, code: str, detail: str = ""):
        kind, text = CODES[code]
        if kind != "error":
            raise ValueError(f"{code} is an event")
        super().__init__(f"{code}: {text}{': ' + detail if detail else ''}")
        self.code = code


def explain(code: str) -> dict:
    """Kind, condition and diagnostic queries of a code."""
    kind, text = CODES[code]
    return {"code": code, "kind": kind, "condition": text, "queries": sorted(q for q in REGISTERED if q.startswith(f"diag_{code.lower()}_"))}
