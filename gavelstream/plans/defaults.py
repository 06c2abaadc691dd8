"""Parameters the queries use unless told otherwise."""

# fixed values
EXCHANGE_RATE = 0.82
AUCTION_DIVISORS = (1007, 1020, 2001, 2019, 2087)
AUCTION_LIST = AUCTION_DIVISORS
LOCAL_CATEGORY = 10
LOCAL_STATES = ("OR", "ID", "CA")
HOT_ITEMS_SIZE = "10 seconds"
HOT_ITEMS_SLIDE = "2 seconds"
NEW_USERS_SIZE = "10 seconds"
SESSION_GAP = "10 seconds"
SESSION_MAX_EVENTS = 100_000

# how far behind the newest event time a stream still takes rows in
DELAY = "0 seconds"
