"""Ticketing analytics as Spark jobs: search, seats, bookings, payments, changes."""
