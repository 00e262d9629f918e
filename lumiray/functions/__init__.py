"""Column expressions; nothing here touches rows."""
