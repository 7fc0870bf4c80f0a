"""Registered queries; importing this package fills the registry."""

from larder.plans import p_calendar, p_demand, p_entries, p_inventory, p_joins, p_ledger, p_models, p_reports, p_scan, p_streaming  # noqa: F401
