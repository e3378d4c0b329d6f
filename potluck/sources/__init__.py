"""Sources: landed expense documents, group configuration, debts, stores, calendars."""
