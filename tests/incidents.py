"""Synthetic incidents: invented hosts, documentation addresses, made-up hashes."""

import hashlib
import json


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def event(payload, k=0, **more):
    base = {
        "starttime": 1767225600000 + 60000 * k, "protocolid": 6, "sourceip": f"192.0.2.{10 + k}", "logsourceid": 7, "qid": 1001, "sourceport": 1000 + k, "eventcount": 1,
        "magnitude": 5, "identityip": "198.51.100.1", "destinationip": "203.0.113.9", "destinationport": 443, "category": 20, "username": None,
        "utf8_payload": payload if payload is None or isinstance(payload, str) else json.dumps(payload),
    }
    return base | more


def common(k, host, detection, **more):
    return {
        "id": 7600000000000000001 + k, "timestamp": 1767225600 + k, "date": f"2026-01-01T00:0{k % 10}:00+00:00", "event_type": "Observed", "event_type_id": 42, "detection": detection,
        "connector_guid": "guid-one", "group_guids": ["g-1", "g-1", None, "g-2"], "severity": "High", "tactics": ["TA01"], "techniques": ["T1001", "T1002"],
        "computer": {"hostname": host, "external_ip": "203.0.113.5", "network_addresses": [{"ip": f"10.1.0.{k}", "mac": "00:00:5e:00:53:01"}, {"ip": None}]},
    } | more


def registry(k, host, key, value, process="sampleplatform.exe"):
    done = {"registry:set": {"app": {"name": process, "path": f"C:\\Tools\\{process}", "sha256": sha(process), "size": 100 + k}, "cmd_line": f"{process} /quiet", "pid": 40 + k, "key": key, "value": value, "data_int": k, "user": {"name": "svc-demo"}}}
    return common(k, host, "Registry Autostart Entry Modified", bp_data={"device": {"os": {"name": "DemoOS", "version": "1.0", "build": "1"}}, "details": {"actions": [], "matched_activity": {"events": [done]}}, "observables": {"registry": [{"key": key, "value": value}], "file": []}, "normalized": {"name": "autostart", "severity_id": 3, "observables": {"all": [process]}}})


HOSTS = [f"AA-STEMX-{1000 + k}.DOMAIN" for k in range(4)] + ["AA-STEMY-2000.DOMAIN"] + [f"BB-OTHER-{3000 + k}.DOMAIN" for k in range(5)]
REGISTRY_KEY = "\\MACHINE\\SOFTWARE\\Demo\\Winlogon Userinit"
THREAT = {"detection_id": "d1", "file": {"disposition": "Malicious", "file_name": "dropper-tool.exe", "file_path": "C:\\Temp\\dropper-tool.exe", "identity": {"sha256": sha("dropper")}, "parent": {"identity": {"sha256": sha("parent")}}}}
CLOUD = {"cloud_ioc": {"short_description": "W32.Demo.ioc", "description": "A scripted download was started by an office program."}, "command_line": {"arguments": "cmd.exe /c echo demo"}, "file": {"file_name": "cmd.exe", "file_path": "C:\\Windows\\cmd.exe", "identity": {"sha256": sha("cmd").upper()}}}

INCIDENTS = {
    "101": [event(registry(k, HOSTS[k], REGISTRY_KEY, "launcher"), k) for k in range(10)],
    "102": [event(registry(k, "CC-HOST-5.DOMAIN", "\\MACHINE\\SOFTWARE\\Demo\\Run", ["hidden-account", "visible-account"][k], "quiet-runner.exe"), k) for k in range(2)],
    "103": [event({k2: v for k2, v in (common(k, "DD-HOST-6.DOMAIN", None) | CLOUD).items() if k2 != "detection"}, k) for k in range(2)],
    "104": [event(common(k, "EE-HOST-7.DOMAIN", "Threat Quarantined Failed Demo") | THREAT, k) for k in range(11)],
    "105": [
        event(None), event("not json"), event("[1, 2]"), event("12"), event({"id": 0}), event('{"id": 5, "severity": "a", "severity": "b"}'),
        event({"id": 9, "severity": "", "tactics": [], "computer": {"hostname": ""}, "event_type_id": 0}), event({"id": 10, "event_type": "2026-01-02T03:04:05 seen at hostname."}),
    ],
}


def raw(events) -> bytes:
    return ("﻿" + json.dumps({"events": events}, ensure_ascii=False)).encode()
