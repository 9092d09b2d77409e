"""Declared schemas: event tables by type, and the tables the batch jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_COMMON = """
    TimeGenerated timestamp, Type string, EventType string, EventSubType string,
    EventResult string, EventResultDetails string, EventCount int,
    EventStartTime timestamp, EventEndTime timestamp, EventSeverity string,
    EventVendor string, EventProduct string, Dvc string, DvcHostname string,
    DvcIpAddr string, DvcId string, DvcAction string, AdditionalFields map<string,string>
"""

_EXTRA = {
    "Authentication": """TargetUsername string, TargetUserId string, TargetUserType string,
        ActorUsername string, SrcIpAddr string, SrcGeoCountry string""",
    "NetworkSession": """SrcIpAddr string, DstIpAddr string, NetworkDirection string,
        DstPortNumber int""",
    "Process": """CommandLine string, ActingProcessName string, TargetProcessName string,
        ParentProcessName string, Process string, ActorUsername string""",
    "File": "FileName string, FilePath string, ActorUsername string",
    "Dns": """DnsQuery string, DnsResponseCodeName string, DnsQueryTypeName string,
        SrcIpAddr string""",
    "WebSession": """Url string, HttpUserAgent string, SrcIpAddr string, DstHostname string,
        HttpStatusCode int""",
    "Registry": "RegistryKey string, ActorUsername string",
}

EVENT_TYPES = tuple(_EXTRA)


def event_schema(event_type: str) -> T.StructType:
    """Columns of one event type: the common ones and its own."""
    return T.StructType.fromDDL(f"{_COMMON}, {_EXTRA[event_type]}")


# The type of a field by the end of its name, the first that fits; all other fields are texts. Fixed values.
_TYPE_OF_ENDING = {
    "Time": "timestamp", "TimeGenerated": "timestamp", "Count": "long", "Bytes": "long", "Packets": "long", "FileSize": "long",
    "BodyBytes": "long", "PortNumber": "int", "VlanId": "string", "StatusCode": "string", "Duration": "long", "Latitude": "double",
    "Longitude": "double", "RiskLevel": "int", "Confidence": "int", "IsActive": "boolean", "AdditionalFields": "map<string,string>",
}


def schema_of_fields(fields: list[str]) -> T.StructType:
    """Columns for the names of a field reference, typed by how a name ends; each name once, in the order given."""
    def kind(name: str) -> str:
        return next((t for ending, t in _TYPE_OF_ENDING.items() if name.endswith(ending)), "string")

    return T.StructType.fromDDL(", ".join(f"`{name}` {kind(name)}" for name in dict.fromkeys(fields)))


def schemas_of_reference(reference: DataFrame, kind: str = "event_type", fields: str = "fields") -> dict[str, T.StructType]:
    """A schema per event type from a field reference, as ``field_reference`` makes it: a row per type, some hundred names each."""
    return {r[0]: schema_of_fields(list(r[1])) for r in reference.select(kind, fields).collect()}


# DDL of the tables the batch jobs read.
RULES = """rule_id string, source_file string, description_raw string, query string,
    tactics array<string>, techniques array<string>, complexity_tier string"""
VERDICTS = "rule_id string, verdict string, notes string"
VARIANTS = "rule_id string, casual string, sop_imperative string"
COMPARISON = """pair_id string, complexity_tier string, system_a_kql string, system_b_kql string,
    system_b_success boolean, system_b_attempts_used int"""
SCORECARD = """template string, completed boolean, fire_ok boolean, nofire_ok boolean,
    total_tokens long, elapsed_s double"""
RATERS = "rule_id string, rater string, condition string, score int"
CALIBRATION = "rule_id string, manual_pass boolean, verifier_pass boolean, verifier_issue string"
CHUNKS = "id string, text string, metadata map<string,string>"
