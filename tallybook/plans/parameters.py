"""Clocks and parameters shared by the named queries and their SQL."""

ORDERS_AS_OF = "1998-07-15 12:00:00"
# The last order seen: a day of many orders, and an id in their midst.
ORDERS_SEEN = ("1995-06-17 00:00:00", 5000)
TASKS_AS_OF = "2024-01-15 12:00:00"
LOG_AS_OF = "2024-01-31 12:00:00"

TASKS_FROM = "2024-01-13 12:00:00"
TASKS_TO = "2024-01-17 12:00:00"

HALF_YEAR = ("1998-01-01", "1998-06-30")
MONTH = ("1998-03-01", "1998-03-31")

PROCESSING_YEAR = 1998

# Stock the sales feed is set against, as a multiple of the products' stock.
STOCK_FACTOR = 40
