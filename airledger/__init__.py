"""Part of airledger."""
