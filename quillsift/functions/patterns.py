"""The detectors' patterns, in RE2's dialect, and their Java forms."""

from __future__ import annotations

from .re2 import to_java

# Patterns that must equal the established ones for equal results.
AWS_KEY_ID = r"\b(AKIA[0-9A-Z]{16})\b"
AWS_SECRET = r"\b([0-9a-zA-Z/+]{40})\b"
AWS_CONTEXT = r"(?i)(aws_secret_access_key|aws_secret_key|secret_access_key|aws_secret|aws_key)"
GOOGLE_KEY = r"\b(AIza[0-9A-Za-z\-_]{35})\b"
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9_-]+ )?PRIVATE KEY-----"
JWT = r"\b(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)\b"
ENV_NAME = r"(?i)(PASSWORD|SECRET|TOKEN|API_KEY|APIKEY|PRIVATE_KEY|AUTH_TOKEN|DB_PASS|DATABASE_PASSWORD|ADMIN_PASS)"
VARIABLE = r"^\$\([A-Za-z0-9_.-]+\)$"
CONTEXT = r"(?i)(password|secret|token|api_key|apikey|auth|credential|private_key|key|bearer)"
PEM_PUBLIC = r"-----BEGIN (?:[A-Z0-9 ]+ )?(?:CERTIFICATE|PUBLIC KEY|CERTIFICATE REQUEST)-----"
PEM_PRIVATE = r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----"
SSH_PUBLIC = r"^(?:ssh-rsa|ssh-ed25519|ssh-dss|ecdsa-sha2-nistp(?:256|384|521))\s"
REFERENCE = r"^(?:arn:aws(?:-[a-z]+)*:|vault:|projects/[^/]+/secrets/|(?:awssm|gcpsm|azurekeyvault|akeyless|sops|k8s)://)"
URL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
URL_USER = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/@\s]*:[^/@\s]+@"
CRYPT_HASH = r"^\$(?:1|2[abxy]?|5|6|7|y|md5|sha1|argon2(?:i|d|id)?|scrypt|pbkdf2(?:-[a-z0-9]+)?)\$"
DATA_URI = r"^data:[a-zA-Z0-9.+\-]+/"
TEMPLATE = r"\{\{|\}\}|\$\{|\$\(|^<[^>]+>$"
PLACEHOLDER = r"(?i)(?:^|[^a-z0-9])(?:change[-_]?me|replace[-_]?me|placeholder|redacted|not[-_]?a[-_]?secret|fixme|dummy[-_](?:value|secret|token|password|key)|your[-_](?:secret|password|token|key))(?:[^a-z0-9]|$)"
NUMBER = r"^[0-9]+$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX_DIGEST = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
IMAGE = r"(?i)(?:^|/)[a-z0-9._-]+(?:/[a-z0-9._-]+)*(?::[a-z0-9._-]+|@sha256:[a-f0-9]{64})$"
DNS_NAME = r"^[a-z0-9](?:[-a-z0-9]*[a-z0-9])?(?:\.[a-z0-9](?:[-a-z0-9]*[a-z0-9])?)*$"
#: First characters of base64 SSH public keys.
SSH_BASE64 = ("AAAAB3NzaC1yc2E", "AAAAC3NzaC1lZDI1NTE5", "AAAAE2VjZHNhLXNoYTItbmlzdHA")
#: Parts of keys whose values are scanned in full.
SENSITIVE_KEYS = ("pass", "secret", "token", "api_key", "apikey", "auth", "credential", "private_key", "key")

RE2 = {name: value for name, value in list(globals().items()) if name.isupper() and isinstance(value, str)}
#: Patterns with the same language as those above, for an engine that backtracks: no repeated group that could overflow the
#: stack, and no two runs over the same characters. A directory before an image's last part may be any, so only the last part counts;
#: the first colon of a URL's user will do if a later one does.
_PARTS = to_java(r"(?:-[a-z]+)*")
FLAT = {
    "IMAGE": to_java(r"(?i)(?:^|/)[a-z0-9._-]+(?::[a-z0-9._-]+|@sha256:[a-f0-9]{64})$"),
    "DNS_NAME": r"\A(?![^\n]*(?:\.[.\-]|-\.))[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?\z",
    "URL_USER": to_java(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/@\s:]*:[^/@\s]+@"),
    "REFERENCE": to_java(REFERENCE).replace(_PARTS, _PARTS[:-3] + "++)*+"),
}
JAVA = {name: to_java(value) for name, value in RE2.items()} | FLAT
