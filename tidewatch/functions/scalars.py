"""Scalar functions on event fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classification slugs and their prose, by priority, then additions of network sensors and of log rules.
CATEGORIES = {
    "attempted-admin": "Attempted Administrator Privilege Gain",
    "attempted-user": "Attempted User Privilege Gain",
    "inappropriate-content": "Inappropriate Content was Detected",
    "policy-violation": "Potential Corporate Privacy Violation",
    "shellcode-detect": "Executable code was detected",
    "successful-admin": "Successful Administrator Privilege Gain",
    "successful-user": "Successful User Privilege Gain",
    "trojan-activity": "A Network Trojan was detected",
    "unsuccessful-user": "Unsuccessful User Privilege Gain",
    "web-application-attack": "Web Application Attack",
    "attempted-dos": "Attempted Denial of Service",
    "attempted-recon": "Attempted Information Leak",
    "bad-unknown": "Potentially Bad Traffic",
    "default-login-attempt": "Attempt to login by a default username and password",
    "denial-of-service": "Detection of a Denial of Service Attack",
    "misc-attack": "Misc Attack",
    "non-standard-protocol": "Detection of a non-standard protocol or event",
    "rpc-portmap-decode": "Decode of an RPC Query",
    "successful-dos": "Denial of Service",
    "successful-recon-largescale": "Large Scale Information Leak",
    "successful-recon-limited": "Information Leak",
    "suspicious-filename-detect": "A suspicious filename was detected",
    "suspicious-login": "An attempted login using a suspicious username was detected",
    "system-call-detect": "A system call was detected",
    "unusual-client-port-connection": "A client was using an unusual port",
    "web-application-activity": "Access to a potentially vulnerable web application",
    "icmp-event": "Generic ICMP event",
    "misc-activity": "Misc activity",
    "network-scan": "Detection of a Network Scan",
    "not-suspicious": "Not Suspicious Traffic",
    "protocol-command-decode": "Generic Protocol Command Decode",
    "string-detect": "A suspicious string was detected",
    "unknown": "Unknown Traffic",
    "tcp-connection": "A TCP connection was detected",
    "coin-mining": "Crypto Currency Mining Activity Detected",
    "command-and-control": "Malware Command and Control Activity Detected",
    "credential-theft": "Successful Credential Theft Detected",
    "domain-c2": "Domain Observed Used for C2 Detected",
    "exploit-kit": "Exploit Kit Activity Detected",
    "external-ip-check": "Device Retrieving External IP Address Detected",
    "pup-activity": "Possibly Unwanted Program Detected",
    "social-engineering": "Possible Social Engineering Attempted",
    "targeted-activity": "Targeted Malicious Activity was Detected",
    "blocked": "Traffic the Sensor Blocked",
    "brute-force": "Brute Force Attack",
    "configuration-change": "Configuration Change",
    "correlated-attack": "Correlated Attack",
    "exploit-attempt": "Exploit Attempt",
    "malware": "Malware Activity Detected",
    "network-event": "Network Event",
    "program-error": "Program Error",
    "suspicious-traffic": "Suspicious Traffic",
    "system-error": "System Error",
    "system-event": "System Event",
    "unsuccessful-admin": "Unsuccessful Administrator Privilege Gain",
}


def category(classtype: Column, known: dict[str, str] = CATEGORIES) -> Column:
    """Prose of a classification slug; an unknown one has its words' first letters raised, the rest untouched."""
    table = F.create_map(*(F.lit(x) for p in known.items() for x in p))
    words = F.transform(F.split(F.rtrim(classtype, F.lit("-")), "-+"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20)))
    return F.coalesce(F.try_element_at(table, classtype), F.array_join(words, " "))


def sid(name: Column) -> Column:
    """First four bytes of the name's MD5 as a number of 31 bits."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def time_fields(value: Column) -> Column:
    """struct(weekday 0 = Sunday, hhmm) of an epoch (seconds; larger numbers are scaled down by thousands) or of an
    ISO time at face value; null otherwise."""
    n = F.when(value.rlike(r"^\d{1,18}$"), value.try_cast("long"))
    most = 99_999_999_999
    seconds = F.when(n <= most, n).when(F.expr("true") & (F.floor(n / 1000) <= most), F.floor(n / 1000)).when(F.floor(n / 1_000_000) <= most, F.floor(n / 1_000_000)).otherwise(F.floor(n / 1_000_000_000))
    iso = F.try_to_timestamp(F.replace(F.regexp_extract(value, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?)", 1), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm[:ss]"))
    at = F.coalesce(F.timestamp_seconds(seconds), iso)
    return F.when(at.isNotNull(), F.struct((F.dayofweek(at) - 1).alias("weekday"), (F.hour(at) * 100 + F.minute(at)).alias("hhmm")))


def flow_endpoints(found: Column, src: str | None, dest: str | None) -> Column:
    """struct(src_ip, dest_ip) lifted from named fields; null when not named or absent."""
    get = lambda n: F.try_element_at(found, F.lit(n)) if n else F.lit(None).cast("string")
    return F.struct(get(src).alias("src_ip"), get(dest).alias("dest_ip"))


def scrub_utf8(raw: Column) -> Column:
    """Bytes as text; invalid runs become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def raw_as_json(line: Column) -> Column:
    """A line that is JSON as a variant of its structure, any other as a variant of its text."""
    return F.coalesce(F.try_parse_json(line), F.try_parse_json(F.to_json(F.array(line)).substr(F.lit(2), F.char_length(F.to_json(F.array(line))) - 2)))
