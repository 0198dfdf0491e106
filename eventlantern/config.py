"""Fixed values and configuration. Values below must equal those of the data model for right results."""

from __future__ import annotations

import json
from pathlib import Path

# Words that carry no meaning in questions.
QUESTION_STOPWORDS = (
    "a an and are as at be by did do does for from give in is it me of on show tell the this to was were "
    "what when where which who with offense event events"
).split()

# File extensions, and the words that search leaves out besides those of questions.
FILE_EXTENSIONS = "exe dll sys bat cmd ps1 vbs js msi com scr dat txt log".split()
SEARCH_STOPWORDS = QUESTION_STOPWORDS + "appear appears found present".split() + FILE_EXTENSIONS

# Fields shown with a search result, in this order.
DISPLAY_FIELDS = (
    "cisco.detection cloud_ioc.short_description normalized.name cloud_ioc.description computer.hostname qradar.sourceip "
    "qradar.destinationip cisco.severity actions.name actions.cmd_line actions.sha256 registry_set.app.name registry_set.app.path "
    "registry_set.app.sha256 registry_set.cmd_line observables.file.name observables.file.path observables.file.sha256 "
    "observables.file.parent.sha256 observables.registry.key observables.registry.value registry_set.key registry_set.value "
    "registry_set.data_txt registry_set.data_int registry_set.user.name"
).split()

# Fields that the smoke search after an intake tries in turn.
SMOKE_FIELDS = (
    "cisco.detection cloud_ioc.short_description normalized.name computer.hostname qradar.sourceip registry_set.app.name "
    "actions.name observables.file.name registry_set.value"
).split()

# Numbers of the scores and routes.
BM25_K1, BM25_B = 1.5, 0.75
FUZZY_WEIGHT, FUZZY_LEAST_RATIO, HOST_LEAST_MEAN = 0.45, 0.72, 0.82
RESOLVE_TOP, RESOLVE_THRESHOLD = 5, 0.25
THRESHOLDS = {
    "exact_field_min_score": 0.75,
    "exact_field_min_gap": 0.10,
    "bm25_min_score_non_identifier": 0.10,
    "bm25_long_exact_token_min_length": 6,
}
UI_LIMITS = (1, 10)
STRONG_REASONS = ("exact_question_match", "alias_phrase_in_question", "question_phrase_in_alias")
SPARSE_FIELDS = 8

# Where each target field is read. `event` is the event, `utf8_payload` its decoded payload; `[]`
# fans out over an array; of several paths the first that is not empty counts.
IDENTITY = {"offense_id": "provided_by_pipeline", "event_index": "generated_by_pipeline", "event_id": "utf8_payload.id"}
FIELDS: dict[str, list[str]] = {
    "qradar.starttime": ["event.starttime"],
    "qradar.sourceip": ["event.sourceip"],
    "qradar.destinationip": ["event.destinationip"],
    "qradar.logsourceid": ["event.logsourceid"],
    "qradar.qid": ["event.qid"],
    "qradar.category": ["event.category"],
    "qradar.magnitude": ["event.magnitude"],
    "qradar.username": ["event.username"],
    "cisco.date": ["utf8_payload.date"],
    "cisco.event_type": ["utf8_payload.event_type"],
    "cisco.event_type_id": ["utf8_payload.event_type_id"],
    "cisco.detection": ["utf8_payload.detection", "utf8_payload.cloud_ioc.short_description"],
    "cisco.severity": ["utf8_payload.severity"],
    "cisco.connector_guid": ["utf8_payload.connector_guid"],
    "cisco.group_guids": ["utf8_payload.group_guids[]"],
    "cisco.tactics": ["utf8_payload.tactics[]"],
    "cisco.techniques": ["utf8_payload.techniques[]"],
    "computer.hostname": ["utf8_payload.computer.hostname"],
    "computer.external_ip": ["utf8_payload.computer.external_ip"],
    "computer.network_ips": ["utf8_payload.computer.network_addresses[].ip"],
    "computer.network_macs": ["utf8_payload.computer.network_addresses[].mac"],
    "computer.os.name": ["utf8_payload.bp_data.device.os.name"],
    "computer.os.version": ["utf8_payload.bp_data.device.os.version"],
    "computer.os.build": ["utf8_payload.bp_data.device.os.build"],
    "computer.hw_info.vendor_name": ["utf8_payload.bp_data.device.hw_info.vendor_name"],
    "computer.hw_info.serial_number": ["utf8_payload.bp_data.device.hw_info.serial_number"],
    "actions.action": ["utf8_payload.bp_data.details.actions[].action"],
    "actions.name": ["utf8_payload.bp_data.details.actions[].name", "utf8_payload.file.file_name"],
    "actions.path": ["utf8_payload.bp_data.details.actions[].path", "utf8_payload.file.file_path"],
    "actions.cmd_line": ["utf8_payload.bp_data.details.actions[].cmd_line", "utf8_payload.command_line.arguments"],
    "actions.sha256": ["utf8_payload.bp_data.details.actions[].sha256", "utf8_payload.file.identity.sha256"],
    "actions.pid": ["utf8_payload.bp_data.details.actions[].pid"],
    "actions.ppid": ["utf8_payload.bp_data.details.actions[].ppid"],
    "actions.status": ["utf8_payload.bp_data.details.actions[].status"],
    "actions.error": ["utf8_payload.bp_data.details.actions[].error"],
    "observables.file.name": ["utf8_payload.bp_data.observables.file[].name", "utf8_payload.file.file_name"],
    "observables.file.path": ["utf8_payload.bp_data.observables.file[].path", "utf8_payload.file.file_path"],
    "observables.file.md5": ["utf8_payload.bp_data.observables.file[].md5"],
    "observables.file.sha1": ["utf8_payload.bp_data.observables.file[].sha1"],
    "observables.file.sha256": ["utf8_payload.bp_data.observables.file[].sha256", "utf8_payload.file.identity.sha256"],
    "observables.file.parent.sha256": ["utf8_payload.file.parent.identity.sha256"],
    "observables.file.signature.trusted": ["utf8_payload.bp_data.observables.file[].signature.trusted"],
    "observables.file.signature.issuer": ["utf8_payload.bp_data.observables.file[].signature.issuer"],
    "observables.file.signature.subject": ["utf8_payload.bp_data.observables.file[].signature.subject"],
    "observables.registry.key": ["utf8_payload.bp_data.observables.registry[].key"],
    "observables.registry.value": ["utf8_payload.bp_data.observables.registry[].value"],
    "registry_set.app.name": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.app.name"],
    "registry_set.app.path": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.app.path"],
    "registry_set.app.sha256": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.app.sha256"],
    "registry_set.app.size": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.app.size"],
    "registry_set.app.original_file_name": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.app.original_file_name"],
    "registry_set.app.original_file_version": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.app.original_file_version"],
    "registry_set.app.original_vendor_name": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.app.original_vendor_name"],
    "registry_set.cmd_line": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.cmd_line"],
    "registry_set.pid": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.pid"],
    "registry_set.puid": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.puid"],
    "registry_set.guid": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.guid"],
    "registry_set.boot_sid": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.boot_sid"],
    "registry_set.ts": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.ts"],
    "registry_set.key": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.key"],
    "registry_set.value": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.value"],
    "registry_set.data_txt": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.data_txt"],
    "registry_set.data_int": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.data_int"],
    "registry_set.data_len": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.data_len"],
    "registry_set.user.domain": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.user.domain"],
    "registry_set.user.name": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.user.name"],
    "registry_set.user.sid": ["utf8_payload.bp_data.details.matched_activity.events[].registry:set.user.sid"],
    "normalized.observables.all": ["utf8_payload.bp_data.normalized.observables.all[]"],
    "normalized.severity_id": ["utf8_payload.bp_data.normalized.severity_id"],
    "normalized.name": ["utf8_payload.bp_data.normalized.name", "utf8_payload.cloud_ioc.short_description"],
    "cloud_ioc.short_description": ["utf8_payload.cloud_ioc.short_description"],
    "cloud_ioc.description": ["utf8_payload.cloud_ioc.description"],
}


def load_mapping(path: str | None = None) -> dict[str, list[str]]:
    """Target field -> paths, from a JSON file with `fields`, or the built-in mapping."""
    if path is None:
        return dict(FIELDS)
    fields = json.loads(Path(path).read_text(encoding="utf-8-sig"))["fields"]
    return {k: [v] if isinstance(v, str) else list(v) for k, v in fields.items()}


def load_aliases(path: str | None = None, fields: dict | None = None) -> dict[str, list[str]]:
    """Field -> phrases, from a JSON file with an `aliases` object, or by rule from the field names."""
    if path is None:
        return default_aliases(list(fields or FIELDS))
    data = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(data.get("aliases"), dict):
        raise ValueError("the alias file needs an 'aliases' object")
    return data["aliases"]


_SPOKEN = {"sourceip": "source ip", "destinationip": "destination ip", "logsourceid": "log source id", "starttime": "start time", "cmd_line": "command line", "pid": "process id", "ppid": "parent process id", "qid": "event name id", "ioc": "indicator"}


def default_aliases(fields: list[str]) -> dict[str, list[str]]:
    """Phrases by rule: the spoken last part of a name, and that part behind the one before it."""
    out = {}
    for f in fields:
        parts = [_SPOKEN.get(p, p.replace("_", " ")) for p in f.split(".")]
        tail = parts[-1]
        group = parts[0].replace(" set", "").rstrip("s")
        own = [tail] if tail not in ("name", "path", "key", "value", "all", "action", "ip") else []
        both = [f"{p} {tail}" for p in dict.fromkeys((parts[-2], group)) if p not in ("qradar", "cisco")]
        out[f] = list(dict.fromkeys([*own, *both]))
    return out


def load_descriptions(path: str | None) -> dict[str, str]:
    """Field -> prose from a JSON object, or an empty description for each field."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig")) if path else {f: "" for f in [*FIELDS, *IDENTITY]}
