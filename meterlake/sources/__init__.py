"""Where usage comes from: log files, growing logs and rate tables."""
