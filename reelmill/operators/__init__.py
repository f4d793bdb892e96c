"""Part of reelmill; see the README for the map of modules."""
