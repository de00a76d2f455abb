"""Raw chain records and label files turned into tables."""
