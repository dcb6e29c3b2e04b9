"""The policy: frozen dataclasses with defaults, read strictly from TOML (an unknown key is an error)."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field

# The actions, and the sections, keys and defaults of the policy below.
ACTIONS = ("remove", "placeholder", "rewrite", "refuse", "allow")


@dataclass(frozen=True)
class HtmlRules:
    script_allowlist: tuple[str, ...] = ()
    frame_origin_allowlist: tuple[str, ...] = ()
    action_script: str = "remove"
    action_event_handler: str = "remove"
    action_dangerous_scheme: str = "rewrite"
    action_frame: str = "placeholder"
    action_meta_refresh: str = "remove"
    placeholder_frame: str = '<div class="sanitized-placeholder"></div>'


@dataclass(frozen=True)
class UrlRules:
    blocklists: tuple[str, ...] = ()
    protected_domains: tuple[str, ...] = ()
    confusables: str = ""
    action_blocked: str = "rewrite"
    action_homograph: str = "rewrite"
    action_userinfo: str = "rewrite"
    action_internal: str = "rewrite"
    action_idn: str = "rewrite"
    action_normalised: str = "rewrite"
    placeholder_url: str = "#blocked"


@dataclass(frozen=True)
class Budgets:
    max_input_bytes: int = 10 << 20
    max_time_ms: int = 10_000
    max_decompress_ratio: int = 10
    max_entity_expansions: int = 1000
    max_image_pixels: int = 50_000_000


@dataclass(frozen=True)
class FetchRules:
    connect_timeout_ms: int = 5000
    read_timeout_ms: int = 5000
    total_timeout_ms: int = 30_000
    redirect_limit: int = 5
    max_response_bytes: int = 10 << 20
    user_agent: str = "siftwell"


@dataclass(frozen=True)
class InputRules:
    extensions: tuple[str, ...] = ("html", "htm")


@dataclass(frozen=True)
class ZipBudget:
    max_compression_ratio: float = 100.0
    max_total_uncompressed_bytes: int = 1 << 30
    max_entry_count: int = 10_000


@dataclass(frozen=True)
class XmlBudget:
    max_entity_depth: int = 20
    max_expanded_size: int = 10 << 20
    max_entity_count: int = 10_000


@dataclass(frozen=True)
class SubresourceRules:
    fetch: bool = False
    max_depth: int = 1
    max_requests: int = 32
    max_total_bytes: int = 50 << 20
    types: tuple[str, ...] = ("css", "js", "image")
    sniff_rule: str = "reject"
    active_content_rule: str = "reject"
    rewrite_refs: bool = True
    action_refused: str = "rewrite"
    zip_budget: ZipBudget = field(default_factory=ZipBudget)
    xml_budget: XmlBudget = field(default_factory=XmlBudget)


@dataclass(frozen=True)
class SsrfRules:
    guard_input_urls: str = "server"
    same_origin_exemption: bool = True
    allow_hosts: tuple[str, ...] = ()
    deny_extra: tuple[str, ...] = ()
    allow_ttl_ms: int = 30_000


@dataclass(frozen=True)
class Policy:
    html: HtmlRules = field(default_factory=HtmlRules)
    urls: UrlRules = field(default_factory=UrlRules)
    budgets: Budgets = field(default_factory=Budgets)
    fetch: FetchRules = field(default_factory=FetchRules)
    input: InputRules = field(default_factory=InputRules)
    subresources: SubresourceRules = field(default_factory=SubresourceRules)
    ssrf: SsrfRules = field(default_factory=SsrfRules)


def _build(kind: type, values: dict, where: str):
    default, known = kind(), {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown key {where}{unknown[0]}")
    made = {}
    for name, value in values.items():
        old = getattr(default, name)
        if dataclasses.is_dataclass(old):
            if not isinstance(value, dict):
                raise ValueError(f"{where}{name} must be a section")
            value = _build(type(old), value, f"{where}{name}.")
        elif isinstance(old, tuple):
            value = tuple(value)
        elif isinstance(old, float) and isinstance(value, int):
            value = float(value)
        elif type(value) is not type(old):
            raise ValueError(f"{where}{name} must be {type(old).__name__}")
        if name.startswith("action_") and value not in ACTIONS:
            raise ValueError(f"{where}{name} must be one of {', '.join(ACTIONS)}")
        made[name] = value
    return kind(**made)


def parse_policy(text: str) -> Policy:
    return _build(Policy, tomllib.loads(text), "")


def load_policy(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return parse_policy(f.read())
