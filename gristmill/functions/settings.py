"""Settings of text models: lines of KEY=value, and which model a provider offers. Secrets are never shown."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

DEFAULT_PROVIDER = "openai"


def parsed_settings(text: str) -> dict[str, str]:
    """KEY=value lines; blank ones, # comments and lines without a key are passed over, `export ` and one pair of quotes go."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        key, sign, value = line.removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if not sign or not key or line.startswith("#"):
            continue
        out[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def merged_settings(own: Mapping[str, str], given: Mapping[str, str], override: bool = False) -> dict[str, str]:
    """What is set already wins, unless told otherwise."""
    return {**own, **given} if override else {**given, **own}


@dataclass(frozen=True)
class ModelConfig:
    """Where a model is asked: keys `provider`, and `<provider>.api_key`, `<provider>.base_url`, `<provider>.model`."""

    provider: str
    model: str
    base_url: str
    api_key: str
    timeout: float
    missing: tuple[str, ...]

    @property
    def ready(self) -> bool:
        return not self.missing

    def shown(self) -> dict[str, object]:
        """For logs: what is there, without any secret."""
        return {"provider": self.provider, "model": self.model, "ready": self.ready, "missing": list(self.missing)}


def resolved_model(settings: Mapping[str, str], default_model: str = "", timeout: float = 60.0) -> ModelConfig:
    """The provider's model: a hosted one needs a key and may fall back to default_model; any other also needs its address and
    its model's name. A timeout that is no number is the default one."""
    provider = (settings.get("provider") or DEFAULT_PROVIDER).strip().lower()
    own = {k: settings.get(f"{provider}.{k}", "") for k in ("api_key", "base_url", "model")}
    needed = ["api_key"] if provider == DEFAULT_PROVIDER else ["api_key", "base_url", "model"]
    try:
        seconds = float(settings.get("timeout_seconds") or timeout)
    except ValueError:
        seconds = timeout
    model = own["model"] or (default_model if provider == DEFAULT_PROVIDER else "")
    return ModelConfig(provider, model, own["base_url"], own["api_key"], seconds, tuple(f"{provider}.{k}" for k in needed if not own[k]))
