"""Declared table schemas, value lists and key relations of the back-office data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, types and nullability ('!' = NOT NULL) of the eleven tables.
_COLUMNS = {
    "customers": """id:long! name:string! email:string phone:string address:string
        created_at:timestamp_ntz updated_at:timestamp_ntz""",
    "products": """id:long! name:string! category:string! description:string
        current_stock:integer! minimum_stock:integer! unit:string!
        created_at:timestamp_ntz updated_at:timestamp_ntz""",
    "orders": """id:long! order_number:string! customer_id:long! total_amount:decimal(10,2)!
        status:string observations:string channel:string! order_date:timestamp_ntz!
        whatsapp_number:string ifood_order:string attendant:string payment_method:string
        amount_received:decimal(10,2) change_given:decimal(10,2)""",
    "order_items": """id:long! order_id:long! product_id:long! quantity:integer!
        unit_price:decimal(10,2)!""",
    "task_categories": "id:long! name:string! color:string! created_at:timestamp_ntz",
    "tasks": """id:long! title:string! description:string due_date:timestamp_ntz!
        priority:string! status:string! category_id:long reminder_minutes:integer
        created_at:timestamp_ntz updated_at:timestamp_ntz reminder_sent:boolean all_day:boolean""",
    "recipes": """id:long! name:string! category:string! prep_time:integer! image_url:string
        instructions:string! notes:string created_at:timestamp_ntz updated_at:timestamp_ntz""",
    "recipe_log": "id:long! recipe_id:long! action:string! created_at:timestamp_ntz",
    "recipe_ingredients": """id:long! recipe_id:long! product_id:long! quantity:decimal(10,2)!
        unit:string! notes:string created_at:timestamp_ntz""",
    "oil_disposals": """id:long! product:string! amount:decimal(10,2)! disposal_date:date!
        notes:string created_at:timestamp_ntz""",
    "financial_transactions": """id:long! description:string! amount:decimal(10,2)! type:string!
        category:string! transaction_date:date! created_at:timestamp_ntz""",
}


def _struct(columns: str) -> T.StructType:
    struct = T.StructType()
    for column in columns.split():
        name, kind = column.split(":")
        struct.add(name, kind.rstrip("!"), nullable=not kind.endswith("!"))
    return struct


SCHEMAS: dict[str, T.StructType] = {name: _struct(text) for name, text in _COLUMNS.items()}

# Allowed values, in declaration order (the order is also the sort order).
ORDER_STATUSES = ("pending", "paid", "preparing", "on_delivery", "delivered")
# Statuses of an order that is not done yet.
OPEN_STATUSES = ("pending", "preparing")
CHANNELS = ("whatsapp", "ifood", "balcao")
PAYMENT_METHODS = ("dinheiro", "cartao_credito", "cartao_debito", "pix", "outro")
TASK_PRIORITIES = ("low", "medium", "high")
TASK_STATUSES = ("pending", "in_progress", "completed")
RECIPE_ACTIONS = ("viewed", "prepared", "printed")
LEDGER_TYPES = ("entrada", "saida")
LEDGER_CATEGORIES = ("venda", "despesa", "investimento", "impostos", "outros")

ENUMS: dict[str, dict[str, tuple[str, ...]]] = {
    "orders": {"status": ORDER_STATUSES, "channel": CHANNELS, "payment_method": PAYMENT_METHODS},
    "tasks": {"priority": TASK_PRIORITIES, "status": TASK_STATUSES},
    "recipe_log": {"action": RECIPE_ACTIONS},
    "financial_transactions": {"type": LEDGER_TYPES, "category": LEDGER_CATEGORIES},
}

# What an omitted column is stored as.
DEFAULTS: dict[str, dict[str, object]] = {
    "products": {"current_stock": 0, "minimum_stock": 5},
    "orders": {"status": "pending"},
    "tasks": {"priority": "medium", "status": "pending", "reminder_sent": False, "all_day": False},
}

# Columns a creation request must fill with something other than NULL, '' or 0.
FILLED: dict[str, tuple[str, ...]] = {
    "products": ("name", "category", "minimum_stock", "unit"),
    "tasks": ("title", "due_date", "priority", "status"),
    "task_categories": ("name", "color"),
}

# Columns a creation request must name, whatever the table's own default is.
STATED: dict[str, tuple[str, ...]] = {"products": ("current_stock",)}

# Optional columns where '' and 0 are stored as NULL.
BLANK_AS_NULL: dict[str, tuple[str, ...]] = {
    "tasks": ("description", "category_id", "reminder_minutes"),
}

# Fixed values: (child table, child column, what deleting the parent does to the child).
REFERENCES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "customers": (("orders", "customer_id", "cascade"),),
    "orders": (("order_items", "order_id", "cascade"),),
    "products": (
        ("order_items", "product_id", "cascade"),
        ("recipe_ingredients", "product_id", "cascade"),
    ),
    "recipes": (
        ("recipe_log", "recipe_id", "cascade"),
        ("recipe_ingredients", "recipe_id", "cascade"),
    ),
    "task_categories": (("tasks", "category_id", "set null"),),
}
