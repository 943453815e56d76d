from datetime import date

import pytest

from tidemark.config import ConfigError, from_dict, in_quiet_range

GOOD = {"source_name": "shop", "own_site": "www.own.org", "expiration_days": 30, "hidden_policy": "pii", "entities": [{"name": "user", "keys": [{"name": "email", "hidden": True}]}], "custom_events": [{"event_type": "login", "keys": [{"name": "who"}]}]}


def test_good():
    cfg = from_dict(GOOD)
    assert cfg.entity("user").id_key == "id" and cfg.funnel_depth == 10


@pytest.mark.parametrize(
    "change",
    [
        {"colour": 1}, {"source_name": "a-b"}, {"expiration_days": -1}, {"expiration_days": None}, {"web_request_expiration_days": 0}, {"web_request_expiration_days": 31}, {"expiration_days": False, "web_request_expiration_days": 3},
        {"entities": [{"name": "u", "speed": 1}]}, {"entities": [{"name": "u", "keys": [{"name": "a", "colour": 1}]}]}, {"entities": [{"name": "u", "materialisation": "cube"}]}, {"entities": [{"name": "u", "primary_key": "id"}]},
        {"entities": [{"name": "u", "hide_primary_key": True}], "hidden_policy": None}, {"entities": [{"name": "u", "expiration_days": 31}]}, {"entities": [{"name": "u", "keys": [{"name": "a", "data_type": "money"}]}]},
        {"entities": [{"name": "u", "keys": [{"name": "created_at"}]}]}, {"entities": [{"name": "u", "keys": [{"name": "a", "hidden": "yes"}]}]}, {"entities": [{"name": "u", "keys": [{"name": "id2", "hidden": True}], "primary_key": "id2"}]},
        {"entities": [{"name": "u", "keys": [{"name": "a", "data_type": "integer_array", "is_array": True}]}]}, {"custom_events": [{"event_type": "web_request"}]}, {"custom_events": [{"event_type": "x", "keys": [{"name": "occurred_at"}]}]},
        {"cdc": {"dataset": ""}}, {"cdc": {"dataset": "d", "reconcile": "yes"}}, {"funnel_depth": 0}, {"own_site": None}, {"own_site": "https://own.org"}, {"events_freshness_days": 0}, {"attribution": ("medium",)},
        {"entities": [{"name": "u", "freshness_days": 1.5}]}, {"entities": [{"name": "u", "keys": [{"name": "a", "is_array": True}]}], "cdc": {"dataset": "d", "legacy_cutoff": "2026-01-01"}},
    ],
)
def test_bad(change):
    with pytest.raises(ConfigError):
        from_dict(GOOD | change)


def test_quiet_ranges():
    assert in_quiet_range(date(2024, 8, 1)) and in_quiet_range(date(2024, 7, 25)) and in_quiet_range(date(2024, 12, 31)) and in_quiet_range(date(2025, 1, 7))
    assert not in_quiet_range(date(2024, 9, 2)) and not in_quiet_range(date(2025, 1, 8))
    assert in_quiet_range(date(2024, 2, 2), [(date(2024, 2, 2), date(2024, 2, 2))])
    with pytest.raises(ConfigError):
        in_quiet_range(date(2024, 2, 2), [(date(2024, 2, 3), date(2024, 2, 2))])
