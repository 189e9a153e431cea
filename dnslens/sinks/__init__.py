"""Writers: event store, exports, packet reports and the session ledger."""
