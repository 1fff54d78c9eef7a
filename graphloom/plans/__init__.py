"""Whole dataflows: conversion of exchange files, registered queries."""
