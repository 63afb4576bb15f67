"""Part of folioforge; see the package README."""
