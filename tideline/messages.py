"""Texts that are output values: contract problems and the details of audit rows."""

# fixed values: problems of an event, by field
REQUIRED = "is required"
NOT_A_UUID = "must be a valid UUID"
TOO_LONG = "must be at most {limit} characters"
NOT_SUPPORTED = " is not a supported {noun} (supported: {allowed})"
NO_TIMESTAMP = "is required and must be an RFC3339 timestamp"
IN_THE_FUTURE = " in the future, which exceeds the {limit} limit (server time is "
TOO_OLD = " old, which exceeds the {limit} limit (server time is "
CHECK_THE_CLOCK = "); check the sending host's clock"
INVALID_EVENT = "invalid event: "
# fixed values: why a record was refused
NOT_AN_EVENT = "message is not a valid telemetry event"
BREAKS_CONTRACT = "message violates the telemetry event contract"
# fixed values: what webhooks and remediation targets answered, and why steps ended
TARGET_STATUS = "remediation target returned status "
WEBHOOK_STATUS = "webhook returned status "
NO_LONGER_ACTIVE = "incident is no longer active"
NOBODY_APPROVED = "nobody approved within the timeout"
REJECTED = "rejected by an operator"
EXHAUSTED = "escalation exhausted"
