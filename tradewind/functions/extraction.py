"""What is read from free text, by name: messages and trade terms."""

from __future__ import annotations

from tradewind.functions.messages import clean, is_supplier_offer, prices, split_quantity, without_prices
from tradewind.functions.terms import lead_days, lead_time, minimum_order, mixed_load

__all__ = ["clean", "is_supplier_offer", "lead_days", "lead_time", "minimum_order", "mixed_load", "prices", "split_quantity", "without_prices"]
