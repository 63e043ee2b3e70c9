"""Scalar Column -> Column functions (all JVM-side built-ins)."""

from clickwise.functions.text import is_blank, java_strip
from clickwise.functions.ids import resolve_click_id, time_bucket_5s, uuid_format
from clickwise.functions.network import extract_client_ip, geo_country_stub, hash_ip, ip_key, ipv4_key, ipv4_to_long
from clickwise.functions.device import device_type_from_ua, normalize_device_type
from clickwise.functions.urls import redirect_url
from clickwise.functions.timefmt import (
    event_time, to_start_of_hour, to_start_of_day, to_yyyymm, late_text,
)

__all__ = [
    "is_blank", "java_strip", "resolve_click_id", "time_bucket_5s", "uuid_format",
    "extract_client_ip", "geo_country_stub", "hash_ip", "ip_key", "ipv4_key", "ipv4_to_long",
    "device_type_from_ua", "normalize_device_type", "redirect_url", "event_time",
    "to_start_of_hour", "to_start_of_day", "to_yyyymm", "late_text",
]
